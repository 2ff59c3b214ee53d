import html as entities
import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from choicefield.llm import chat, html, queries
from conftest import SMALL


def article(page):
    """What the generated pages hold: the blocks inside their article element."""
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_pages_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = queries.op4_html_text(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b &lt; c&nbsp; d", "a\nb < c d"), ("<script>if(a<b){}</script>t", "t"),
    ("<p>x</p><!-- open", "x"), ("<a", ""), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<body><header><h1>Site</h1></header><nav><a href=1>one</a></nav><div class=sidebar>side words here</div><div id=content><h1>Title</h1>"
     "<p>Long text here, quite a bit of it indeed.</p><form>Your mail <input></form><p>More of it <a href=x>link</a> and so on.</p>"
     "<ul><li>first point of some length</li><li>second</li></ul></div><div class='comments'><p>Nice post, I read all of it!</p></div>"
     "<div class=cookie-notice>We use cookies</div><footer>end</footer></body>",
     "Title\nLong text here, quite a bit of it indeed.\nMore of it link and so on.\nfirst point of some length\nsecond")])
def test_small_pages(page, text):
    assert html.main_text(page) == text


def test_odd_pages(spark):
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href='x'>", "</a>", "text ", "<li>", "</ul>", "<td>", "</table>", "<br>", "<!--", "<script>", "<", ">", "&amp;", '"']
    for _ in range(3000):
        html.main_text("".join(rng.choice(parts) for _ in range(40)))
    assert html.main_text("<div>" * 20000 + "x") == "x"
    frame = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<p>a", "t"), (2, None, "<p>a", "t"), (None, "u", "", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html.extract(frame).collect()), key=str) == sorted([(1, "u", "", 0), (2, None, "a", 1), (2, None, "a", 1), (None, "u", "", 0)], key=str)
    assert html.extract(frame.limit(0)).count() == 0


def brute(rows):
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return out


def test_chat_query(spark):
    probe = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    assert {r.conv_id: tuple(r)[1:5] for r in queries.op10_chat(spark, SMALL).collect()} == brute(rows)
    plan = queries.op10_chat(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", "a\\b ### x ####</turn>\n</turn"), (1, 1, "assistant", None), (1, 1, "assistant", "é😀</turn>\n### user: hi\\"), (2, 0, "to:ol\n", "x"),
            (2, 1, None, "\\"), (3, 0, "human", "q"), (3, 1, "gpt", "r"), (3, 2, "user", ""), (4, 0, "user", "\x01  \"{}$1 \\$"), (4, 1, "assistant", "$0"),
            (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "a"), (6, 0, "user", "</turn>"), (6, 1, "assistant", "<\\/turn>\\"), (6, 2, "user", "###"),
            (7, 0, "user", "same"), (7, 0, "user", "same"), (8, None, "user", "x" * 200000), (None, 1, "assistant", "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("record", F.lit(2))
    formatted = chat.format_conversations(chat.records_of_turns(frame))
    want = brute([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(formatted).collect()} == want
    assert {r.layout for r in formatted.collect()} == {"messages", "conversations", "prompt_completion", "system_prompt"}
    assert chat.format_conversations(chat.records_of_turns(frame.limit(0))).count() == 0


def test_layouts(spark):
    records = ['{"instruction":"i","input":"x","output":null}', '{"question":"q","answer":7}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
               '{"zzz":1}', "bad", None]
    out = chat.canonical(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [r.layout for r in out] == ["instruction_input", "question_answer", "conversations", None, None, None]
    assert [[tuple(t) for t in r.turns] if r.turns else None for r in out] == [
        [("user", "i\n\nx"), ("assistant", "")], [("user", "q"), ("assistant", "7")], [("user", "a"), ("assistant", "b")], None, None, None]
