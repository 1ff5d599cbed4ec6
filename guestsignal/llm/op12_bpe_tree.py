"""BPE encoding of whole texts by tree concatenation, and decoding.

A long text is cut in halves, these again, down to stretches of LEAF code points that are encoded on their
own; texts of more than SPREAD bytes are dealt to tasks as rows in between. The encodings are then put
together in pairs up the tree. What was encoded next to a cut may be wrong, so a window around each join,
two units wide on each side at first, is encoded anew, and grows until both sides agree with
it: its outermost units are those that the sides had. Beyond them nothing can differ.

Units are of two kinds.
- Pieces between ASCII white space. The supported tokenizers normalise, split and encode each of them on
  its own (see `_supported`), so agreement on a piece is agreement on all further ones.
- Tokens inside a pre-token of LONG or more letters, which nothing splits. There an encoding is
  the one sequence in which each two neighbours are what their joint text is encoded to: this
  holds if every merge makes a token of its own from two that earlier merges made (checked
  when the tokenizer is read). Neighbours that are taken from the window or from a side keep it, so one shared token is enough.

Defined cases: a null text is empty and has no ids. Repeated rows give repeated, equal results. doc_id
may be null. Strings of special tokens inside a text become their ids, as in the library. A text of any
length is one row and is encoded whole. Columns other than doc_id and text are ignored. An empty
table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.llm.shared import table, tasks
from guestsignal.llm.vec import SPACE, chunks, string_buffer

#: Code points of a leaf; letters from which on a pre-token is a tree of its own.
LEAF, LONG = 2_048, 1_024
#: Bytes from which on a text's stretches become rows for several tasks.
SPREAD = 1 << 16
#: Pieces and words whose ids a Python worker remembers, in each of two generations.
REMEMBERED = 200_000
#: Texts that are encoded at once.
ROWS = 256
#: Tokens that are decoded at once.
TOKENS = 1 << 20

#: Fixed value: the split of the supported vocabulary after lower-casing.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split where all characters are printable ASCII or letters of Latin-1.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"
)

TEXT, WORDS, PART = "text", "words", "part"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass
class Stretch:
    """A piece of a text that is encoded on its own.

    text: raw text, cut anywhere. words: whole pre-tokens with a space between them. part: part
    of one pre-token. Cut at a side means that the text goes on there without white space or word end.
    """

    kind: str
    content: str
    cut_left: bool = False
    cut_right: bool = False


@dataclass
class Encoded:
    """Units of a stretch in order and their ids, unsigned 32-bit integers."""

    kind: str
    cut_left: bool
    cut_right: bool
    units: list = field(default_factory=list)
    ids: list[bytes] = field(default_factory=list)


def _byte_letters() -> dict[int, int]:
    """The letter of byte-level vocabularies for each byte: itself if it is printable in
    Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class Remembered:
    """A bounded memory: what was not asked for while it filled up once is forgotten."""

    def __init__(self, size: int = REMEMBERED) -> None:
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.new[key] = found
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class TreeEncoder:
    """The tokenizer of a file, applied by tree concatenation."""

    def __init__(self, path: str, leaf: int = LEAF, long: int = LONG) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        own = json.loads(self.tokenizer.to_str())
        _supported(own)
        self.model, self.leaf, self.long = self.tokenizer.model, leaf, long
        self.suffix = own["model"]["end_of_word_suffix"] or ""
        self.special_ids = {t["content"]: t["id"] for t in own["added_tokens"]}
        marks = "|".join(re.escape(t["content"]) for t in own["added_tokens"])
        self.marks = re.compile(f"({marks})") if marks else None
        self.letters = _byte_letters()
        self.pieces, self.plain_words, self.words = Remembered(), Remembered(), Remembered()
        self.vocabulary: pa.Array | None = None
        self.long_piece = re.compile(f"[^\\x20\\x09-\\x0D]{{{long},}}")

    # -- cutting ---------------------------------------------------------------------------

    def cut(self, text: str, most: int) -> list[Stretch]:
        """Stretches of at most `most` code points or letters; only long pieces are looked into."""
        out, end = [], 0
        for found in self.long_piece.finditer(text):
            out += _halves(TEXT, text[end : found.start()], most)
            out += self._cut_piece(found.group(), most)
            end = found.end()
        return out + _halves(TEXT, text[end:], most)

    def _cut_piece(self, piece: str, most: int) -> Iterator[Stretch]:
        """A long piece, normalised and split by the library: pre-tokens of fewer letters than
        `long` go together, a longer one is cut in halves."""
        together, size = [], 0
        for word in self._pre_tokens(piece):
            if len(word) >= self.long and word not in self.special_ids:
                if together:
                    yield Stretch(WORDS, " ".join(together))
                together, size = [], 0
                yield from _halves(PART, word, most)
                continue
            if together and size + len(word) > most:
                yield Stretch(WORDS, " ".join(together))
                together, size = [], 0
            together.append(word)
            size += len(word)
        if together:
            yield Stretch(WORDS, " ".join(together))

    def _pre_tokens(self, piece: str) -> Iterator[str]:
        """Pre-tokens in byte letters; special tokens stay as they are."""
        for k, part in enumerate(self.marks.split(piece) if self.marks else [piece]):
            if k % 2:
                yield part
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    yield word

    # -- encoding --------------------------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """ids of a whole text."""
        return b"".join(self.put_together([self.encoded(s) for s in self.cut(text, self.leaf)]).ids)

    def encoded(self, stretch: Stretch) -> Encoded:
        """A stretch of any size: a tree down to leaves."""
        if stretch.kind == WORDS:
            found = [self._word(w) for w in stretch.content.split(" ")]
            return Encoded(WORDS, False, False, [], found)
        leaves = _halves(stretch.kind, stretch.content, self.leaf)
        leaves[0].cut_left, leaves[-1].cut_right = stretch.cut_left, stretch.cut_right
        return self.put_together([self._leaf(leaf) for leaf in leaves])

    def _leaf(self, leaf: Stretch) -> Encoded:
        if leaf.kind == TEXT:
            units = leaf.content.encode().split()
            ids = self._pieces(units)
        else:
            units, ids = self._tokens(leaf.content)
        return Encoded(leaf.kind, leaf.cut_left, leaf.cut_right, units, ids)

    def _pieces(self, units: list[bytes]) -> list[bytes]:
        memory, new = self.pieces, self.pieces.new
        out = [new.get(u) for u in units]
        for k, found in enumerate(out):
            if found is None:
                unit = units[k]
                found = memory.get(unit)
                if found is None:
                    found = self._piece(unit)
                    memory.put(unit, found)
                out[k] = found
        return out

    def _piece(self, unit: bytes) -> bytes:
        """ids of a piece without white space as the library gives them."""
        text = unit.decode()
        if self.marks and self.marks.search(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not PLAIN.fullmatch(text):
            return b"".join([self._word(w) for w in self._pre_tokens(text)])
        known, out = self.plain_words, []
        for word in PLAIN_SPLIT.findall(text.lower()):
            found = known.get(word)
            if found is None:
                found = self._word(word.encode().decode("latin-1").translate(self.letters))
                known.put(word, found)
            out.append(found)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """ids of a whole pre-token in byte letters."""
        found = self.words.get(word)
        if found is None:
            if word in self.special_ids:
                found = _packed([self.special_ids[word]])
            else:
                found = _packed([t.id for t in self.model.tokenize(word)])
            if len(word) < self.long:
                self.words.put(word, found)
        return found

    def _tokens(self, letters: str) -> tuple[list[str], list[bytes]]:
        """Tokens of a part of a pre-token as if the word ended with it, and their ids."""
        found = self.model.tokenize(letters)
        units = [t.value for t in found]
        units[-1] = units[-1].removesuffix(self.suffix)
        return units, [_packed([t.id]) for t in found]

    # -- putting together ------------------------------------------------------------------

    def put_together(self, parts: list[Encoded]) -> Encoded:
        """All parts as one: those that a cut connects up a tree, what comes of that in order."""
        chains: list[list[Encoded]] = []
        for part in parts:
            if chains and chains[-1][-1].cut_right and part.cut_left:
                chains[-1].append(part)
            else:
                chains.append([part])
        whole = [self._tree(chain_) for chain_ in chains] or [Encoded(TEXT, False, False)]
        if len(whole) == 1:
            return whole[0]
        return Encoded(
            whole[-1].kind, whole[0].cut_left, whole[-1].cut_right,
            list(chain.from_iterable(w.units for w in whole)),
            list(chain.from_iterable(w.ids for w in whole)),
        )

    def _tree(self, parts: list[Encoded]) -> Encoded:
        """Neighbours in pairs until one is left."""
        while len(parts) > 1:
            pairs = [self.joined(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0]

    def joined(self, a: Encoded, b: Encoded) -> Encoded:
        """The encoding of two neighbours with a cut between them, as one."""
        window = self._text_window if a.kind == TEXT else self._part_window
        wide = 2
        while (found := window(a, b, wide)) is None:
            wide *= 2
        units, ids, rest = found
        return Encoded(
            a.kind, a.cut_left, b.cut_right,
            a.units[:-wide] + units + b.units[rest:], a.ids[:-wide] + ids + b.ids[rest:],
        )

    def _text_window(self, a: Encoded, b: Encoded, wide: int) -> tuple | None:
        """The window's pieces, their ids and how many of b's pieces they stand for."""
        left, right = a.units[-wide:], b.units[:wide]
        units = left[:-1] + [left[-1] + right[0]] + right[1:]
        ids = self._pieces(units)
        starts = wide >= len(a.units) or ids[0] == a.ids[-wide]
        ends = wide >= len(b.units) or ids[-1] == b.ids[wide - 1]
        return (units, ids, wide) if starts and ends else None

    def _part_window(self, a: Encoded, b: Encoded, wide: int) -> tuple | None:
        """The same for tokens. The window's last token is taken for a word end, which it is
        only if b ends with it."""
        left, right = a.units[-wide:], b.units[:wide]
        units, ids = self._tokens("".join(chain(left, right)))
        if wide < len(a.units) and (units[0], ids[0]) != (left[0], a.ids[-wide]):
            return None
        if wide >= len(b.units):
            return units, ids, wide
        at, place = {}, sum(map(len, left))
        for k, unit in enumerate(right):
            at[place, b.ids[k]] = k
            place += len(unit)
        place = 0
        for j, unit in enumerate(units[:-1]):
            if (k := at.get((place, ids[j]))) is not None:
                return units[: j + 1], ids[: j + 1], k + 1
            place += len(unit)
        return None

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids."""
        if self.vocabulary is None:
            self.vocabulary = vocabulary(self.tokenizer)
        return _texts(ids, self.vocabulary)


def vocabulary(tokenizer) -> pa.Array:
    """The tokens by id; ValueError if texts are made of them in another way than with a space between."""
    if tokenizer.decoder is not None:
        raise ValueError("this tokenizer has a decoder of its own")
    n = tokenizer.get_vocab_size(with_added_tokens=True)
    return pa.array([tokenizer.id_to_token(i) or "" for i in range(n)])


def _texts(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    edge = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy())])
    shown = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), tokens.take(ids.flatten()))
    return pc.binary_join(shown, " ")


def _halves(kind: str, content: str, most: int) -> list[Stretch]:
    """Halves of halves with at most `most` characters."""
    n, parts = len(content), 1
    while -(-n // parts) > most:
        parts *= 2
    edge = sorted({n * k // parts for k in range(parts + 1)})
    cut = [0 < e < n and (kind == PART or not _blank(content[e - 1] + content[e])) for e in edge]
    return [
        Stretch(kind, content[i:j], cut[k], cut[k + 1])
        for k, (i, j) in enumerate(zip(edge, edge[1:]))
    ] if n else []


def _blank(two: str) -> bool:
    """Whether one of two neighbouring characters is ASCII white space."""
    return any(c in " \t\n\x0b\x0c\r" for c in two)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _supported(own: dict) -> None:
    """Raises ValueError unless pieces between ASCII white space are encoded one by one and the
    merges are in an order in which neighbours decide."""
    model, before = own["model"], own["pre_tokenizer"] or {}
    normal = own["normalizer"] or {}
    steps = [s["type"] for s in normal.get("normalizers", [normal] if normal else [])]
    splits = before.get("pretokenizers", [before])
    good = (
        set(steps) <= {"NFC", "Replace", "Lowercase"}
        and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": SPLIT} and splits[0]["behavior"] == "Removed"
        and splits[0]["invert"] and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
        and model["type"] == "BPE" and not model["dropout"] and not model["ignore_merges"]
        and not model["byte_fallback"] and not model["continuing_subword_prefix"]
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in own["added_tokens"])
        and not any(re.search(r"\s", t["content"]) for t in own["added_tokens"])
    )
    made: set[str] = set()
    results = [a + b for a, b in model["merges"]]
    late = set(results)
    for (a, b), result in zip(model["merges"], results):
        good = good and not ((a in late and a not in made) or (b in late and b not in made))
        good = good and result not in made
        made.add(result)
    if not good:
        raise ValueError("a tokenizer of this kind can't be put together from stretches")


_encoders: dict[tuple, TreeEncoder] = {}


def _encoder(path: str, leaf: int, long: int) -> TreeEncoder:
    """One for each Python worker."""
    key = path, leaf, long
    if key not in _encoders:
        _encoders[key] = TreeEncoder(path, leaf, long)
    return _encoders[key]


def _id_lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(f) // 4 for f in found])
    ids = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def _has_long_piece(rows: pa.RecordBatch, long: int) -> np.ndarray:
    """Rows with `long` bytes or more in which there is no ASCII white space."""
    raw, offsets = string_buffer(rows.column("text"))
    blank = np.union1d(np.flatnonzero(SPACE[raw]), offsets)
    gap = np.flatnonzero(np.diff(blank) >= long)
    out = np.zeros(rows.num_rows, bool)
    out[np.searchsorted(offsets, blank[gap], "right") - 1] = True
    return out


def encode(
    docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF, long: int = LONG, spread: int = SPREAD
) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text."""
    return _encoded(docs, Plan(tokenizer or default_tokenizer(), leaf, long, spread, False))


def round_trip(
    docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF, long: int = LONG, spread: int = SPREAD
) -> DataFrame:
    """The same with `decoded`, the text of the ids, made where they are."""
    return _encoded(docs, Plan(tokenizer or default_tokenizer(), leaf, long, spread, True))


@dataclass(frozen=True)
class Plan:
    path: str
    leaf: int
    long: int
    spread: int
    decoded: bool

    @property
    def schema(self) -> str:
        return "doc_id bigint, ids array<int>" + ", decoded string" * self.decoded

    def encoder(self) -> TreeEncoder:
        return _encoder(self.path, self.leaf, self.long)

    def columns(self, doc_id: pa.Array, found: list[bytes]) -> dict[str, pa.Array]:
        ids = _id_lists(found)
        out = {"doc_id": doc_id, "ids": ids}
        return out | {"decoded": self.encoder().decode(ids)} if self.decoded else out


def _encoded(docs: DataFrame, plan: Plan) -> DataFrame:
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                texts = some.column("text").to_pylist()
                found = []
                for text, looked_into in zip(texts, _has_long_piece(some, plan.long)):
                    cut = own.cut(text, plan.leaf) if looked_into else _halves(TEXT, text, plan.leaf)
                    found.append(b"".join(own.put_together([own.encoded(s) for s in cut]).ids))
                yield pa.RecordBatch.from_pydict(plan.columns(some.column("doc_id"), found))

    size = F.octet_length("text")
    short = rows.filter(size <= plan.spread).mapInArrow(here, plan.schema)
    return short.unionByName(_dealt(rows.filter(size > plan.spread), plan))


STRETCHES = "doc_id bigint, th string, copies bigint, k int, kind string, content string, cut_left boolean, cut_right boolean"


def _dealt(rows: DataFrame, plan: Plan) -> DataFrame:
    """The same for long texts: their stretches are encoded wherever there is a task and put
    together by document, equal rows once."""
    th = F.sha2("text", 256)
    once = rows.groupBy("doc_id", th.alias("th")).agg(
        F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.encoder()
        for batch in batches:
            for start in range(batch.num_rows):
                row = batch.slice(start, 1).to_pylist()[0]
                parts = own.cut(row["text"], plan.spread // 4)
                n = len(parts)
                same = lambda value, kind: pa.array([value] * n, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        same(row["doc_id"], pa.int64()), same(row["th"], pa.string()),
                        same(row["copies"], pa.int64()), pa.array(range(n), pa.int32()),
                        pa.array([s.kind for s in parts]), pa.array([s.content for s in parts]),
                        pa.array([s.cut_left for s in parts]), pa.array([s.cut_right for s in parts]),
                    ],
                    ["doc_id", "th", "copies", "k", "kind", "content", "cut_left", "cut_right"],
                )

    def encode_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.encoder()
        for batch in batches:
            for start in range(batch.num_rows):
                some = batch.slice(start, 1)
                s = some.select(["kind", "content", "cut_left", "cut_right"]).to_pylist()[0]
                found = own.encoded(Stretch(**s))
                sizes = np.array([len(u) if s["kind"] == PART else len(i) // 4 for u, i in _paired(found)], "<i4")
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([b"".join(found.ids)], pa.binary()), pa.array([sizes.tobytes()], pa.binary())],
                    [*some.schema.names, "ids", "sizes"],
                )

    def put_together(parts: pa.Table) -> pa.Table:
        own = plan.encoder()
        ordered = sorted(parts.to_pylist(), key=lambda r: r["k"])
        ids = b"".join(own.put_together([_again(r) for r in ordered]).ids)
        doc_id = pa.array([ordered[0]["doc_id"]], pa.int64())
        return pa.table(plan.columns(doc_id, [ids]) | {"copies": pa.array([ordered[0]["copies"]])})

    dealt = once.mapInArrow(cut, STRETCHES).repartition(tasks(rows.sparkSession), "doc_id", "th", "k")
    whole = (
        dealt.mapInArrow(encode_stretches, f"{STRETCHES}, ids binary, sizes binary")
        .groupBy("doc_id", "th").applyInArrow(put_together, f"{plan.schema}, copies bigint")
    )
    again = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copies")
    return whole.withColumn("copies", again).drop("copies")


def _paired(found: Encoded) -> Iterator[tuple]:
    """Units and their ids; the units of whole pre-tokens are not kept."""
    return zip_longest(found.units, found.ids)


def _again(row: dict) -> Encoded:
    """An encoded stretch from its row. sizes: letters of each token of a part, else ids of each unit."""
    sizes = np.frombuffer(row["sizes"], "<i4")
    ends = np.cumsum(np.ones_like(sizes) if row["kind"] == PART else sizes) * 4
    ids = [row["ids"][i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
    units: list = []
    if row["kind"] == TEXT:
        units = row["content"].encode().split()
    elif row["kind"] == PART:
        edge = np.cumsum(sizes).tolist()
        units = [row["content"][i:j] for i, j in zip([0, *edge[:-1]], edge)]
    return Encoded(row["kind"], row["cut_left"], row["cut_right"], units, ids)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows of `encoded` with `decoded`, the library's text of their ids, special tokens
    included. A tokenizer without a decoder puts a space between its tokens. Null ids are none;
    a column `decoded` of the input is replaced."""
    path = tokenizer or default_tokenizer()
    encoded = encoded.drop("decoded")
    names = encoded.columns
    schema = encoded.withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokens = vocabulary(Tokenizer.from_file(path))
        for batch in batches:
            sizes = pc.list_value_length(batch.column("ids")).fill_null(0).to_numpy()
            for start, stop in chunks(sizes, TOKENS):
                some = batch.slice(start, stop - start)
                decoded = _texts(some.column("ids"), tokens)
                yield pa.RecordBatch.from_arrays([*some.columns, decoded], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = round_trip(table(spark, sf_dir, "documents"))
    numbers = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return made.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
