"""BPE by a tokenization automaton: merges become a deterministic automaton, words are encoded by its transitions.

The automaton reads tokens. It starts as one state with an arc for every base symbol back to itself, which accepts every string
of base symbols. Each merge (a, b) in order is one gadget: where an arc a leads to a state with an arc b, that arc a is turned to
a copy of the state without b, and an arc ab goes straight to where b led. Afterwards the paths are exactly the encodings after
this merge, so after the last one a path is an encoding and each text has one. All arcs with one label lead to one state
(``Automaton.to``), and a copy differs from its model by one arc, so a gadget takes constant space: the label whose arcs were
turned, the label lost, the number of the merge. ``Automaton.follows`` reads these records.

``Transducer`` turns it into one that reads the symbols of a word: its states are the arcs in progress, each with the tokens not
yet certain, and its transitions are worked out when first met and kept in a table. Tokens are emitted as soon as all arcs in
progress agree on them, so memory does not grow with the word. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, hold, picked, text_slices

STATES = 200_000
KEPT = 500_000
LONG = 64
#: white space of the public pre-tokenizer; str.split() also cuts at the four separators U+001C to U+001F
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: a word of Latin letters that the normaliser only turns to lower case, and a mark after it: cut without the library, one by one
_PLAIN = re.compile(r"([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+)([.,]?)")


def byte_signs() -> dict[int, int]:
    """Byte -> the sign that byte-level vocabularies write for it: printable bytes stand for themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class Automaton:
    """The tokenization automaton of ordered ``merges`` (left, right, product) over ``base`` symbols; symbols are any hashable."""

    def __init__(self, base: Iterable, merges: Iterable[tuple]):
        self.owner, self.made = [None], [-1]  # of a state: the label of the arcs turned to it, the gadget that made it
        self.born = dict.fromkeys(base, -1)
        self.to = dict.fromkeys(self.born, 0)
        self.first = dict(self.to)  # where the arcs of a label led before any gadget turned them
        self.gone: dict[tuple, int] = {}  # (label of the arcs turned, label lost): the gadget
        self.left: dict = {}
        for number, (a, b, ab) in enumerate(merges):
            if ab in self.born:
                raise ValueError(f"two ways to make the token {ab!r}")
            self._gadget(number, a, b, ab)

    def _gadget(self, number: int, a, b, ab) -> None:
        met, after = self.follows(self.to[a], b), self.to[b]
        if met:
            self.owner.append(a)
            self.made.append(number)
            self.gone[a, b] = number
            self.to[a] = len(self.made) - 1
        self.to[ab] = self.first[ab] = after
        self.born[ab] = number
        self.left[ab] = a if met else None

    def follows(self, state: int, token) -> bool:
        """Whether ``state`` has an arc ``token``. A copy took over the arcs that its model had when it was made, but the one gone,
        and afterwards got an arc ab with every merge whose a it had. Copies that one label's arcs were turned to, one after the
        other, are passed in one look at ``gone``."""
        owner, upto = self.owner[state], self.made[state]
        while True:
            born = self.born[token]
            while owner is not None:
                if self.gone.get((owner, token), born) in range(born + 1, upto + 1):
                    return False
                if self.born[owner] <= born:
                    break
                state = self.first[owner]
                owner, upto = self.owner[state], self.made[state]
            if born < 0:
                return True
            upto, token = min(upto, born), self.left[token]
            if token is None:
                return False


class Transducer:
    """Words to tokens by table-driven transitions. ``tokens`` maps the spelling of each token (a string) to the token."""

    def __init__(self, automaton: Automaton, tokens: dict[str, int], final: str = ""):
        self.automaton, self.tokens, self.final = automaton, tokens, final
        self.begun = {s[:i] for s in tokens for i in range(1, len(s))}
        self.rows: dict[tuple, dict] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all transitions; a word in progress keeps the rows that it can reach."""
        self.rows = {}
        self.start = self._row((("", 0, ()),))

    def _row(self, state: tuple) -> dict:
        """Transitions of a state, {symbol: (row of the next state, tokens that became certain)}; under None the state itself."""
        row = self.rows.get(state)
        if row is None:
            if len(self.rows) > STATES:
                self.reset()
            row = self.rows[state] = {None: state}
        return row

    def _step(self, row: dict, symbol: str) -> tuple[dict, tuple]:
        """Every arc in progress reads the symbol; the one that is complete and allowed after its state begins the next arc."""
        on, done = [], None
        for spelt, at, path in row[None]:
            spelt += symbol
            token = self.tokens.get(spelt)
            if done is None and token is not None and self.automaton.follows(at, token):
                done = "", self.automaton.to[token], (*path, token)
            if spelt in self.begun:
                on.append((spelt, at, path))
        if done is None:
            raise ValueError(f"no token ends with {symbol!r}")
        on.append(done)
        sure = tuple([t[0] for t in takewhile(lambda t: len(set(t)) == 1, zip(*[path for _, _, path in on]))])
        out = row[symbol] = self._row(tuple([(spelt, at, path[len(sure):]) for spelt, at, path in on])), sure
        return out

    def encode(self, word: str) -> list[int]:
        """Tokens of a word; its last symbol carries the mark ``final``."""
        if not word:
            return []
        row, out = self.start, []
        for symbol in word[:-1]:
            row, sure = row.get(symbol) or self._step(row, symbol)
            if sure:
                out += sure
        symbol = word[-1] + self.final
        row, sure = row.get(symbol) or self._step(row, symbol)
        return [*out, *sure, *row[None][-1][2]]

    @staticmethod
    def decode(tokens: Iterable[int], spelling: dict[int, str]) -> str:
        """The labels of the arcs, joined as the public library does without a decoder."""
        return " ".join([spelling[t] for t in tokens])


class Words:
    """A public word-level tokenizer file: its normaliser and pre-tokenizer cut texts into words, the automaton encodes them."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, tokenizer = parts["model"], tokenizers.Tokenizer.from_file(path)
        if parts["decoder"] is not None or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError(f"{path}: only byte-level BPE with an end-of-word suffix and without a decoder is supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
            raise ValueError(f"{path}: added tokens must stand for themselves")
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        automaton = Automaton(set(ids.values()) - {ab for _, _, ab in merges}, merges)
        self.transducer = Transducer(automaton, ids, model["end_of_word_suffix"] or "")
        self.spelling = {i: s for s, i in ids.items()} | {t["id"]: t["content"] for t in parts["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.signs = byte_signs()
        self.normal, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.codes: dict[str, bytes] = {}
        self.labels: dict[str, str] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian unsigned 32-bit integers."""
        code = self.words.get(word)
        if code is None:
            code = array("I", self.transducer.encode(word)).tobytes()
            if len(word) <= LONG:
                self.words[word] = code
        return code

    def pieces(self, chunks: list[str]) -> Iterator[bytes]:
        """Codes of pieces of text without white space: words, cut for all pieces in one call (a gap ends a piece)."""
        code, end = [], 0
        for word, (start, stop) in self.split(self.normal(" ".join(chunks))):
            if start > end:
                yield b"".join(code)
                code = []
            code.append(self.word(word))
            end = stop
        if chunks:
            yield b"".join(code)

    def with_special(self, chunk: str) -> bytes:
        """Code of a piece with special tokens in it."""
        return b"".join([array("I", [self.special[p]]).tobytes() if p in self.special else b"".join(self.pieces([p]))
                         for p in self.cut.split(chunk) if p])

    def learn(self, chunks: list[str]) -> None:
        """Remember the codes and labels of pieces without white space."""
        codes, spelling, other, marked = self.codes, self.spelling, [], []
        for c in chunks:
            plain = _PLAIN.fullmatch(c)
            if plain:
                letters, mark = plain.groups()
                code = self.word(letters.lower().encode().decode("latin-1").translate(self.signs))
                codes[c] = code + self.word(mark) if mark else code
            else:
                (marked if self.cut and self.cut.search(c) else other).append(c)
        found = list(self.pieces(other))
        if len(found) != len(other):  # some sign became white space, or none
            found = [b"".join(self.pieces([c])) for c in other]
        codes.update(zip(other, found))
        codes.update((c, self.with_special(c)) for c in marked)
        for c in chunks:
            self.labels[c] = self.transducer.decode(memoryview(codes[c]).cast("I"), spelling)

    def texts(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text; short pieces are remembered."""
        codes, labels = self.codes, self.labels
        if len(codes) > KEPT:
            codes.clear()
            labels.clear()
        if len(self.words) > KEPT:
            self.words.clear()
        cut = [[c for c in _SPACE.split(t) if c] if _SEPARATORS.search(t) else t.split() for t in texts]
        fresh = [c for c in set().union(*cut) if c not in codes]
        self.learn(fresh)
        out = [(b"".join(map(codes.__getitem__, c)), " ".join(filter(None, map(labels.__getitem__, c)))) for c in cut]
        for c in fresh:
            if len(c) > LONG:
                del codes[c], labels[c]
        return out


_READY: dict[str, Words] = {}


def ready(path: str) -> Words:
    """One automaton for each Python worker and file."""
    hold(__name__, _READY.clear)
    if path not in _READY:
        _READY[path] = Words(path)
    return _READY[path]


def _code_rows(batch: pa.RecordBatch, path: str, whole: bool) -> Iterator[dict]:
    words = ready(path)
    for part in text_slices(batch):
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for code, decoded in words.texts([t or "" for t in part.column("text").to_pylist()]):
            out["n_tokens"].append(len(code) // 4)
            out["ids_sha256"].append(sha256(code).hexdigest())
            out["decoded_sha256"].append(sha256(decoded.encode()).hexdigest())
            if whole:
                out["ids"].append(memoryview(code).cast("I").tolist())
                out["decoded"].append(decoded)
        yield {"doc_id": part.column("doc_id")} | out


def encode_decode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; with ``whole`` also the ids and the text decoded from them.

    ``path`` names a tokenizer file that every executor has. Special tokens that stand in a text are those tokens, none are added.
    The decoded text is that of the public library: labels joined by a space, as the file names no decoder. Null and empty texts
    have no ids. Repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    rows = picked(df, doc_id=doc_id, text=text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return arrow_map(rows, _code_rows, schema + (", ids array<bigint>, decoded string" if whole else ""), path, whole)
