"""Token ids of a corpus as compressed binary blocks (see coder).

The documents are range-partitioned and sorted by doc_id; a task tokenises its documents and
packs whole documents into frames of about BLOCK_IDS ids. A frame's data is one or several
coder blocks, so a very long document spans blocks but not frames. Frames are written as
files in the shared folder, in order: the folder is the output, and reading it back needs nothing else.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestsignal.llm import coder
from guestsignal.llm.shared import NO_ID, id_again, stored, table, tasks
from guestsignal.llm.vec import chunks, string_buffer

END_ID = 2
#: Words whose ids a Python worker remembers; at twice as many the rarer ones are forgotten.
CACHE_WORDS = 250_000
#: Words that the model encodes as one string; bytes of text that are cut at once.
JOINED, CHUNK_BYTES = 50, 1 << 23

#: Marks that are a token of their own after a word.
PLAIN_MARKS = ".,;:!?"


def _byte_letters() -> dict[int, int]:
    """The letter of byte-level vocabularies for each byte: itself if it is printable in
    Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()

FRAMES = "part int, frame int, n_docs int, n_ids bigint, doc_ids binary, data binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Places where a text may be cut: before a single space or line end between other characters.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")

_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(PLAIN_MARKS.encode())] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begin : begin + size] of all entries back to back, and where each one starts and ends."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends


def _joined(words: list[str], before: str, end: str, many: int) -> list[str]:
    """Strings of `many` words each, with `before` in front of each word and `end` behind it."""
    return [
        before + (end + before).join(words[k : k + many]) + end for k in range(0, len(words), many)
    ]


def _split(found: list, end: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, and place and count of each word's: up to the id `end`, or (None) of each string."""
    lists = [e.ids for e in found]
    flat = np.fromiter(chain.from_iterable(lists), np.uint32)
    if end is None:
        ends = np.cumsum([len(ids) for ids in lists], dtype=np.int64)
        return flat, np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
    ends = (flat == end).nonzero()[0]
    place = np.concatenate([[0], ends + 1])[: len(ends)]
    return flat, place, ends - place


class WordTokenizer:
    """ids of whole texts by the tokenizers library, each distinct word encoded once.

    A byte-level BPE of this kind never joins text across the start of a single space or line end
    that stands between two other characters, so the pieces that start there can be encoded one by
    one, and a line end or a mark behind a letter or digit by itself. What is left is a word: "word"
    stands for " word", "\\nword" for the word behind a line end. A text's first piece is taken for
    one behind a line end, whose ids are then left out. Texts in which white space touches white
    space at a space or line end are cut by CUT, and texts that hold an added token not at all.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = json.loads(self.tokenizer.to_str())
        self.by_piece = self._splits_at_spaces(own)
        self.between = self._separator(own["model"]) if self.by_piece else None
        self.odd: dict[str, bytes] = {}
        # ids of a line end and of each mark, then those of the words
        fixed = self._encode(["\n", *PLAIN_MARKS])
        self.store = np.frombuffer(b"".join(fixed), "<u4").astype(np.uint32)
        size = np.array([len(ids) // 4 for ids in fixed], np.int64)
        self.fixed_begin, self.fixed_size = np.cumsum(size) - size, size
        self.fixed, self.filled = len(self.store), len(self.store)
        self.known: dict[str, int] = {}
        # for each word: place and count of its ids, whether it touches white space, chunks with it
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.torn, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)

    def _splits_at_spaces(self, own: dict) -> bool:
        before = own.get("pre_tokenizer") or {}
        return (
            own.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
        )

    def _separator(self, model: dict) -> str | None:
        """A control character that no merge holds, so that words on its sides are encoded as
        if alone; None if there is none or the model treats whole strings in another way."""
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if model.get("type") != "BPE" or any(model.get(name) for name in options):
            return None
        merged = set(chain.from_iterable(chain.from_iterable(model["merges"])))
        for byte in (*range(9), *range(14, 28)):
            letter = chr(BYTE_LETTERS[byte])
            if letter in model["vocab"] and letter not in merged:
                return chr(byte)
        return None

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """ids of each text, unsigned 32-bit integers; null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_piece:
            yield from (np.frombuffer(ids, "<u4") for ids in self._encode(texts.to_pylist()))
            return
        for a, e in chunks(np.diff(string_buffer(texts)[1]), CHUNK_BYTES):
            yield from self._chunk(texts.slice(a, e - a))

    def _chunk(self, texts: pa.Array) -> list[np.ndarray]:
        lines = pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n")
        cuts = pc.split_pattern(lines, " ")
        places = cuts.offsets.to_numpy().astype(np.int64)
        places -= places[0]
        pieces = cuts.flatten().dictionary_encode()
        which = pieces.indices.to_numpy()
        lead, words, mark = self._parts(pieces.dictionary)
        # three units for each distinct piece: a line end, the word, a mark; each may be missing
        begin = np.zeros((len(lead), 3), np.int64)
        size = np.zeros((len(lead), 3), np.int64)
        torn = self._words(words, begin[:, 1], size[:, 1])
        begin[:, 0], size[:, 0] = self.fixed_begin[0], np.where(lead, self.fixed_size[0], 0)
        begin[:, 2], size[:, 2] = self.fixed_begin[mark], np.where(mark > 0, self.fixed_size[mark], 0)
        ids, ends = _gathered(self.store, begin.ravel(), size.ravel())
        begin, size = ends[:-1].reshape(-1, 3)[which, 0], size.sum(axis=1)[which]
        # each text starts with an empty piece and a line end that are not its own
        size[places[:-1]] = 0
        begin[places[:-1] + 1] += self.fixed_size[0]
        size[places[:-1] + 1] -= self.fixed_size[0]
        torn = torn[which]
        torn[places[:-1]] = False
        apart = np.add.reduceat(torn, places[:-1]).astype(bool)
        for token in self.added:
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        size[np.repeat(apart, np.diff(places))] = 0
        flat, ends = _gathered(ids, begin, size)
        out = [flat[a:e] for a, e in pairwise(ends[places].tolist())]
        for k in apart.nonzero()[0].tolist():
            out[k] = np.frombuffer(self._torn(texts[k].as_py()), "<u4")
        if len(self.known) > 2 * CACHE_WORDS:
            self._forget()
        return out

    def _parts(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Whether pieces begin with a line end, their words, and the number of the mark that is cut
        off behind an ASCII letter or digit or a letter from U+00C0 to U+023F, else 0."""
        raw, offsets = string_buffer(pieces)
        start, end = offsets[:-1], offsets[1:]
        at = np.concatenate([np.zeros(3, np.uint8), raw])
        lead = (end > start) & (at[np.minimum(start + 3, len(at) - 1)] == ord("\n"))
        last, before, first = at[end + 2], at[end + 1], at[end]
        letter = (first >= 0xC3) & (first <= 0xC8) & ~((first == 0xC3) & ((before == 0x97) | (before == 0xB7)))
        letter &= (before >= 0x80) & (end - start >= 3)
        cut = _MARK[last] & (end - start >= 2) & (_ALNUM[before] | letter)
        mark = np.zeros(256, np.int64)
        mark[list(PLAIN_MARKS.encode())] = np.arange(1, len(PLAIN_MARKS) + 1)
        keep = np.ones(len(raw), bool)
        keep[end[cut] - 1] = False
        offsets = np.concatenate([[0], np.cumsum(end - start - cut)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(offsets), pa.py_buffer(raw[keep]))
        return lead, words, np.where(cut, mark[last], 0)

    def _words(self, words: pa.Array, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Set place and count of the words' ids; returns which of them touch white space."""
        distinct = words.dictionary_encode()
        names, before = distinct.dictionary.to_numpy(zero_copy_only=False), len(self.known)
        codes = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = (codes < 0).nonzero()[0]
        if len(new):
            self._learn(names[new].tolist())
            codes[new] = np.arange(before, before + len(new))
        self.uses[codes] += 1
        codes = codes[distinct.indices.to_numpy()]
        begin[:], size[:] = self.begin[codes], self.size[codes]
        return self.torn[codes]

    def _torn(self, text: str) -> bytes:
        """ids of a text that is cut at fewer places, or not at all."""
        if any(token in text for token in self.added):
            return self._encode([text])[0]
        pieces, odd = CUT.split(text), self.odd
        if len(odd) > CACHE_WORDS:
            odd.clear()
        missing = [piece for piece in set(pieces) if piece not in odd]
        if missing:
            odd.update(zip(missing, self._encode(missing)))
        return b"".join([odd[piece] for piece in pieces])

    def _learn(self, names: list[str]) -> None:
        """ids of new words: letters go to the model directly, anything else through the whole
        tokenizer, in both cases many joined to one string."""
        begin, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        torn = np.zeros(len(names), bool)
        plain = np.fromiter(map(str.isalpha, names), bool, len(names))
        line_letters, line_others, others = [], [], []
        for k in (~plain).nonzero()[0].tolist():
            name = names[k]
            body = name[1:] if name[:1] == "\n" else name
            if not body or body[0].isspace() or body[-1].isspace():
                torn[k] = True
            elif body is name:
                others.append(k)
            else:
                (line_letters if body.isalpha() else line_others).append(k)
        for found, before, ids in (
            (plain.nonzero()[0].tolist(), " ", self._model_ids),
            (line_letters, "", self._model_ids),
            (others, " ", self._tokenizer_ids),
            (line_others, "", self._tokenizer_ids),
        ):
            words = [names[k] if before else names[k][1:] for k in found]
            flat, place, count = ids(words, before)
            begin[found], size[found] = self.filled + place, count
            self._keep(flat)
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
        self.torn = np.concatenate([self.torn, torn])
        self.uses = np.concatenate([self.uses, np.zeros(len(names), np.int64)])

    def _keep(self, ids: np.ndarray) -> None:
        end = self.filled + len(ids)
        if end > len(self.store):
            self.store = np.concatenate([self.store[: self.filled], np.zeros(end, np.uint32)])
        self.store[self.filled : end] = ids
        self.filled = end

    def _model_ids(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of words of letters by the model alone, and place and count of each word's."""
        end = self.between
        joined = _joined(words, before, end or "", JOINED if end else 1)
        letters = [j.encode().decode("latin-1").translate(BYTE_LETTERS) for j in joined]
        found = self.model.encode_batch_fast(letters, add_special_tokens=False)
        return _split(found, end and self.model.token_to_id(chr(BYTE_LETTERS[ord(end)])))

    def _tokenizer_ids(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words of any kind by the whole tokenizer, with a line end between them."""
        single = self.fixed_size[0] == 1
        joined = _joined(words, before, "\n" if single else "", JOINED if single else 1)
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        return _split(found, int(self.store[0]) if single else None)

    def _forget(self) -> None:
        """Keep the words that the most chunks held, at most CACHE_WORDS."""
        least = np.partition(self.uses, -CACHE_WORDS)[-CACHE_WORDS]
        keep = (self.uses > least).nonzero()[0]
        names = list(self.known)
        self.known = {names[k]: n for n, k in enumerate(keep.tolist())}
        self.size, self.torn, self.uses = self.size[keep], self.torn[keep], self.uses[keep] // 2
        ids, ends = _gathered(self.store, self.begin[keep], self.size)
        self.store = np.concatenate([self.store[: self.fixed], ids])
        self.begin, self.filled = self.fixed + ends[:-1], len(self.store)


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _frame(part: int, frame: int, ids: list[int], held: list[np.ndarray]) -> dict:
    lengths = np.array([len(h) for h in held], np.int64)
    flat = np.concatenate(held)
    blocks, begin = [], 0
    for start in range(0, max(1, len(flat)), coder.BLOCK_IDS):
        piece = flat[start : start + coder.BLOCK_IDS]
        blocks.append(coder.encode_block(piece, lengths if start == 0 else lengths[:0]))
    begin = np.array([len(b) for b in blocks], "<u4").tobytes()
    return {
        "part": part, "frame": frame, "n_docs": len(ids), "n_ids": int(len(flat)),
        "doc_ids": np.array(ids, "<i8").tobytes(),
        "data": len(blocks).to_bytes(4, "little") + begin + b"".join(blocks),
    }


def read_frame(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids and document lengths of a frame; ValueError if a block is damaged."""
    n = int.from_bytes(data[:4], "little")
    sizes = np.frombuffer(data, "<u4", n, 4)
    ends = 4 + 4 * n + np.cumsum(sizes, dtype=np.int64)
    found = [coder.decode_block(data[e - s : e]) for s, e in zip(sizes.astype(np.int64), ends)]
    ids = np.concatenate([f[0] for f in found])
    lengths = found[0][1].astype(np.int64)
    if int(lengths.sum()) != len(ids):
        raise ValueError("document lengths of a token frame do not match")
    return ids, lengths


def write(
    docs: DataFrame, name: str = "tokens", tokenizer: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Write the ids of `docs` (doc_id, text) in ascending doc_id order; returns the frames read back.

    Rows with the same doc_id follow each other in text order, null ids come first; a null or
    empty text has only the end id.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id")
    own = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    ordered = own.repartitionByRange(tasks(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _tokenizer(path).ids
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        ids, held, size, frame = [], [], 0, 0
        kinds = [pa.int32()] * 3 + [pa.int64(), pa.binary(), pa.binary()]

        def full() -> pa.RecordBatch:
            row = _frame(part, frame, ids, held)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kind) for v, kind in zip(row.values(), kinds)], list(row)
            )

        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                ids.append(doc_id)
                held.append(np.concatenate([found, end]))
                size += len(held[-1])
                if size >= coder.BLOCK_IDS - 4096:
                    yield full()
                    ids, held, size, frame = [], [], 0, frame + 1
        if ids:
            yield full()

    return stored(ordered.mapInArrow(pack, FRAMES), name)


def read(frames: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the frames."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lengths = read_frame(batch.column("data")[r].as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lengths, ends)]
                n = len(lengths)
                doc_ids = np.frombuffer(batch.column("doc_ids")[r].as_py(), "<i8")
                yield pa.RecordBatch.from_pydict({
                    "part": np.full(n, batch.column("part")[r].as_py(), np.int32),
                    "frame": np.full(n, batch.column("frame")[r].as_py(), np.int32),
                    "doc_id": doc_ids, "before": ends - lengths, "n_tokens": lengths,
                    "ids_crc32": np.array(crc, np.int64),
                })

    schema = "part int, frame int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    # one row for each partition, then one for each frame of a partition
    sizes = frames.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        frames.select("part", "frame", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own"))
        .join(parts, "part")
        .select("part", "frame", (F.col("base") + F.col("own")).alias("offset"))
    )
    decoded = frames.select("part", "frame", "doc_ids", "data").mapInArrow(unpack, schema)
    return decoded.join(offsets, ["part", "frame"]).select(
        id_again(), (F.col("offset") + F.col("before")).cast("bigint").alias("start"),
        "n_tokens", "ids_crc32",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
