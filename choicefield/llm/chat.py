"""Chat formatting: records of any known layout become canonical turns, then one string per conversation with a loss mask.

A record is a JSON text. Its fingerprint is a hash of its nested field paths, whatever their types and values; a registry of
declarative layouts maps fingerprints to an expression that reads the turns. Only DataFrame and SQL functions are used.

The template writes a turn as ``### role: text</turn>`` and a newline. Inside texts and roles a backslash is doubled, ``###`` becomes
``\\#\\#\\#`` and ``</turn>`` becomes ``<\\/turn>``; roles also escape the colon. So a control string never occurs inside a turn and
``read_back`` restores every text exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, picked

HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout: a record that has its field paths, and SQL that reads its turns from the variant ``v``."""

    name: str
    example: str
    turns: str


def _listed(field: str, role: str, text: str) -> str:
    read = f"variant_get(v, '$.{field}', 'array<struct<{role}: string, {text}: string>>')"
    return f"transform({read}, t -> named_struct('role', t.`{role}`, 'text', t.`{text}`))"


def _fixed(*turns: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{role}', 'text', {text})" for role, text in turns) + ")"


def _field(name: str) -> str:
    return f"variant_get(v, '$.{name}', 'string')"


_INSTRUCTION = f"concat({_field('instruction')}, if(coalesce({_field('input')}, '') = '', '', concat('\\n\\n', {_field('input')})))"
_PEOPLE = "transform({}, t -> named_struct('role', coalesce(map('human', 'user', 'gpt', 'assistant')[t.role], t.role), 'text', t.text))"

LAYOUTS = [
    Layout("messages", '{"messages": [{"role": "", "content": ""}]}', _listed("messages", "role", "content")),
    Layout("turns", '{"turns": [{"role": "", "text": ""}]}', _listed("turns", "role", "text")),
    Layout("conversations", '{"conversations": [{"from": "", "value": ""}]}', _PEOPLE.format(_listed("conversations", "from", "value"))),
    Layout("prompt_completion", '{"prompt": "", "completion": ""}', _fixed(("user", _field("prompt")), ("assistant", _field("completion")))),
    Layout("prompt_response", '{"prompt": "", "response": ""}', _fixed(("user", _field("prompt")), ("assistant", _field("response")))),
    Layout("system_prompt", '{"system": "", "prompt": "", "completion": ""}',
           _fixed(("system", _field("system")), ("user", _field("prompt")), ("assistant", _field("completion")))),
    Layout("question_answer", '{"question": "", "answer": ""}', _fixed(("user", _field("question")), ("assistant", _field("answer")))),
    Layout("instruction", '{"instruction": "", "output": ""}', _fixed(("user", _field("instruction")), ("assistant", _field("output")))),
    Layout("instruction_input", '{"instruction": "", "input": "", "output": ""}', _fixed(("user", _INSTRUCTION), ("assistant", _field("output")))),
]


def fingerprint(record: Column) -> Column:
    """Hash of a JSON record's nested field paths; null for a null record and for one that is no JSON."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    paths = F.regexp_replace(shape, r": (?:[A-Z]+(?:\([0-9,]+\))?)(?=[,>])", "")
    return F.when(shape.isNotNull(), F.hex(F.xxhash64(paths))).alias("fingerprint")


def canonical(df: DataFrame, record: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` and ``turns`` in place of columns of those names.

    ``turns`` is null, and so is ``layout``, for a record of unknown layout; no row is dropped. Null texts and roles become empty.
    """
    spark = df.sparkSession
    known = spark.range(1).select(*[fingerprint(F.lit(x.example)).alias(x.name) for x in layouts]).first()
    shape = fingerprint(column(record))
    layout = F.coalesce(*[F.when(shape == known[x.name], x.name) for x in layouts])
    base = df.drop("fingerprint", "layout", "turns", "v").withColumns({"fingerprint": shape, "layout": layout, "v": F.try_parse_json(column(record))})
    read = F.coalesce(*[F.when(F.col("layout") == x.name, F.expr(x.turns).cast(TURNS)) for x in layouts])
    filled = F.transform(read, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return base.withColumn("turns", filled).drop("v")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\#\\#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/:])", "$1")


def formatted(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_mask``, an array of (start, length) in code points of the formatted string.

    The mask covers the text of each turn whose role is ``assistant``. Null turns give a null string and mask, no turns an empty one.
    """
    def parts(t: Column) -> Column:
        head = F.concat(F.lit(HEAD), F.replace(escaped(t["role"]), F.lit(":"), F.lit("\\:")), F.lit(SEP))
        text = escaped(t["text"])
        return F.struct(F.concat(head, text, F.lit(TAIL)).alias("piece"), F.char_length(head).alias("head"), F.char_length(text).alias("size"),
                        (t["role"] == "assistant").alias("learn"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + p["head"]).cast("bigint").alias("start"), p["size"].cast("bigint").alias("length"))
        return F.struct((acc["at"] + p["head"] + p["size"] + len(TAIL)).cast("bigint").alias("at"),
                        F.when(p["learn"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    done = df.drop("formatted", "loss_mask").withColumn("parts", F.transform(column(turns), parts))
    return done.withColumns({"formatted": F.array_join(F.transform("parts", lambda p: p["piece"]), ""),
                             "loss_mask": F.aggregate("parts", start, step, lambda acc: acc["mask"])}).drop("parts")


def read_back(text: Column) -> Column:
    """The turns of a formatted string."""
    pieces = F.split(text, TAIL.replace("/", "\\/"), -1)
    head = r"(?s)^### ((?:[^\\:]|\\.)*+): "  # possessive: the engine loops, where it would call itself for every sign of a role
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(
        unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_replace(p, head, "")).alias("text")))


def masked_text(text: Column, mask: Column) -> Column:
    """All text under a loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(text, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def records_of_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): the turn rows of each conversation as one JSON record, in the layout that fits it best.

    A question and an answer become prompt and completion, with a system turn before them ``system`` too; conversations of only
    user, assistant and system turns with an odd number of them a list of ``from`` and ``value``, all others a list of messages.
    Null texts and roles are empty. Rows are ordered by turn, those of one turn by role and text; repeated rows are turns of their own.
    """
    rows = picked(df, conv_id=conv_id, turn=turn, role=role, text=text).withColumns(
        {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    each = rows.groupBy("conv_id").agg(turns.alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text_at = lambda i: F.col("t")[i]["text"]
    people = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text_at(0).alias("prompt"), text_at(1).alias("completion"))))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
              F.to_json(F.struct(text_at(0).alias("system"), text_at(1).alias("prompt"), text_at(2).alias("completion"))))
        .when(plain & (F.size("t") % 2 == 1), F.to_json(F.struct(F.transform("t", lambda x: F.struct(
            people[x["role"]].alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))))
    return each.select("conv_id", record.alias("record"))


def format_conversations(df: DataFrame, record: str = "record") -> DataFrame:
    """Records to ``layout``, ``turns``, ``formatted`` and ``loss_mask``; see ``canonical`` and ``formatted``. An empty table gives none."""
    return formatted(canonical(df, record))


def digests(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from ``formatted`` and ``loss_mask``.

    A row without a formatted string (a record of no known layout, or beyond the limits of the JSON parser: 20 million characters
    in one string, 128 MB in all) raises an error; it has no digests."""
    whole = F.when(F.col("formatted").isNull(), F.raise_error(F.concat(F.lit("no formatted string for "), F.coalesce(column(key).cast("string"), F.lit("null"))))
                   .cast("string")).otherwise(F.col("formatted"))
    df = df.withColumn("formatted", whole)
    back = df.select(column(key), "formatted", read_back(F.col("formatted")).alias("back"),
                     masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    lines = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(column(key), F.size("back").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("bigint").alias("formatted_chars"))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, whose texts hold the template's own control strings."""
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("\\### Assistant: </turn> ok").alias("text"))
    return picked(conversations, conv_id="conv_id", turn="turn", role="role", text="text").unionByName(probe)
