"""Spelling variants: frequent words that differ by one letter, and the form each should have.

Near words are found by a trie over frequency vectors. A word's vector says how many letters of each
letter group it has; one inserted letter adds one to one count (a surplus), one deleted letter takes
one away (a deficit), a replaced letter does both, or neither inside a group. So the words near to
a word lie at the leaves that a depth-first walk reaches with a budget of one surplus and one
deficit. Of two near words the one that lacks the first differing count asks and the other one
is found, so a walk spends its surplus first and each pair comes up once.

The trie is spread over tasks by its upper levels: the routes of a word through the first
FIRST_LEVELS counts are rows (seven at most), and a node with more than NODE_WORDS words is opened
by one more level, again as rows, until its words fit a task. The rest of the trie is built in the
task that gets the node, as sorted arrays, and walked by all words that were routed there.
At a leaf, words are met by equal first or last halves (one edit leaves one of them as it was), never
all with all, and are then compared letter by letter.

Defined cases: a null text has no words, a null doc_id counts as the empty text in the hash. Repeated rows
count as often as they occur. Forms of equal n go to the smallest word in code-point order. Words may have
any length. Columns other than doc_id and text are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.llm.shared import stored, table
from guestsignal.llm.vec import signed, span_hash, sums

#: Fixed values of the contract.
LETTER = "A-Za-z\\u00C0-\\u00FF"
EVERY = 199
LEAST_LETTERS, LEAST_N, RATIO = 6, 5, 5

GROUPS = 16
FIRST_LEVELS = 3
#: A trie node with more words than this is opened by one more level.
NODE_WORDS = 20_000
#: Words that walk together, pairs that are compared together, letters compared in a matrix.
WALKERS, PAIRS, WIDE = 1 << 16, 1 << 18, 64
#: Following forms doubles its reach each time, and n grows RATIO times with each form.
DOUBLINGS = 5

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted_words(docs: DataFrame, every: int = EVERY, letters: int = LEAST_LETTERS) -> DataFrame:
    """word, n: lower-cased runs of letters over all texts, some of them with one letter deleted.

    A run of fewer than `letters` can't give a word that counts, so only longer ones are taken out.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"([{LETTER}]{{{letters},}})"), F.lit(1))
    doc_id = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))
    run = F.translate("run", UPPER, UPPER.lower())
    size = F.length("run")
    drop = F.pmod(F.col("h"), size).cast("int")
    shorter = F.concat(
        F.substring("run", F.lit(1), drop), F.substring("run", drop + F.lit(2), size)
    )
    return (
        docs.select(doc_id.alias("doc"), F.explode(runs).alias("run"))
        .select("doc", run.alias("run"))
        .withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
        .select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
        .filter(F.length("word") >= letters)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The letters of each group: the commonest have groups of their own, the others are dealt out.

    There are at most as many letters as the alphabet has, 116.
    """
    letters = (
        words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''")
        .groupBy("letter").count().collect()
    )
    ranked = [r["letter"] for r in sorted(letters, key=lambda r: (-r["count"], r["letter"]))]
    out = [""] * groups
    for k, letter in enumerate(ranked):
        out[k if k < groups else groups - 1 - k % groups] += letter
    return out


def _count_of(letters: str) -> Column:
    """How many of `letters` a word has."""
    return F.length("word") - F.length(F.translate("word", letters, "")) if letters else F.lit(0)


def _node(counts: Column) -> Column:
    return F.array_join(F.transform(counts, lambda c: c.cast("string")), ",")


def _opened(routes: DataFrame, letters: str) -> DataFrame:
    """Routes one level further down: the word's own count, or one more or one less if the budget
    allows it. spent: 0 nothing, 1 the surplus, 2 the deficit as well."""
    own = _count_of(letters)
    step = lambda count, spent: F.struct(count.cast("int").alias("count"), spent.cast("int").alias("spent"))
    spent = F.col("spent")
    steps = F.array(
        step(own, spent),
        F.when(spent == 0, step(own + 1, F.lit(1))),
        F.when((spent == 1) & (own > 0), step(own - 1, F.lit(2))),
    )
    return (
        routes.withColumn("step", F.explode(F.array_compact(steps)))
        .withColumn("counts", F.concat("counts", F.array(F.col("step.count"))))
        .withColumn("spent", F.col("step.spent"))
        .drop("step")
    )


def routed(words: DataFrame, groups: list[str], levels: int, node_words: int) -> DataFrame:
    """node, level, spent, word, n: each word at each node its walk can reach.

    A word with spent = 0 is one of the node's own words.
    """
    routes = words.select("word", "n", F.lit(0).alias("spent"), F.array().cast("array<int>").alias("counts"))
    own = words.select("word", F.array().cast("array<int>").alias("counts"))
    for letters in groups[:levels]:
        routes = _opened(routes, letters)
        own = own.withColumn("counts", F.concat("counts", F.array(_count_of(letters))))
    parts = []
    for level in range(levels, len(groups) + 1):
        nodes = own.groupBy(_node(F.col("counts")).alias("node")).agg(F.count(F.lit(1)).alias("held"))
        met = routes.withColumn("node", _node(F.col("counts"))).join(nodes, "node")
        last = level == len(groups)
        ends = F.lit(True) if last else F.col("held") <= node_words
        parts.append(met.filter(ends).select("node", F.lit(level).alias("level"), "spent", "word", "n"))
        if last or (nodes.agg(F.max("held")).first()[0] or 0) <= node_words:
            break
        # only words of nodes that stay open are asked and counted further down
        large = nodes.filter(F.col("held") > node_words).select("node")
        open_own = own.withColumn("node", _node(F.col("counts"))).join(large, "node", "left_semi")
        own = open_own.withColumn("counts", F.concat("counts", F.array(_count_of(groups[level])))).drop("node")
        routes = _opened(met.filter(F.col("held") > node_words).drop("node", "held"), groups[level])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Words:
    """Words of one task as letter codes; every letter of the alphabet is one Latin-1 byte."""

    def __init__(self, words: list[str]) -> None:
        self.text = words
        coded = [w.encode("latin-1") for w in words]
        self.size = np.array([len(c) for c in coded], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.raw = np.frombuffer(b"".join(coded), np.uint8)
        self.total = sums(self.raw.astype(np.uint64) + np.uint64(1))

    def counts(self, group_of: np.ndarray, first: int, groups: int) -> np.ndarray:
        """Letters of each group from `first` on, a row for each word."""
        out = np.zeros((len(self.size), groups), np.int64)
        row = np.repeat(np.arange(len(self.size)), self.size)
        np.add.at(out, (row, group_of[self.raw]), 1)
        return out[:, first:]

    def part(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the letters a to b of each row's word."""
        return span_hash(self.total, self.start[rows] + a, self.start[rows] + b)

    def letters(self, rows: np.ndarray, width: int, from_end: bool = False) -> np.ndarray:
        """The first or last `width` letters, zeros where a word has none."""
        k = np.arange(width)
        at = self.start[rows + 1, None] - 1 - k if from_end else self.start[rows, None] + k
        return np.where(k < self.size[rows, None], self.raw[np.clip(at, 0, len(self.raw) - 1)], 0)


def one_edit(a: str, b: str) -> bool:
    """b is a with one letter replaced or inserted."""
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a != b and a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _verified(words: Words, asks: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether words `found` are words `asks` with one letter replaced or inserted."""
    out = np.zeros(len(asks), bool)
    wide = words.size[found] > WIDE
    for i in np.flatnonzero(wide):
        out[i] = one_edit(words.text[asks[i]], words.text[found[i]])
    rest = np.flatnonzero(~wide)
    if len(rest):
        a, b = asks[rest], found[rest]
        width = int(words.size[b].max())
        differs = words.letters(a, width) != words.letters(b, width)
        replaced = differs.sum(axis=1) == 1
        head = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        differs = words.letters(a, width, True) != words.letters(b, width, True)
        tail = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        equal = words.size[a] == words.size[b]
        out[rest] = np.where(equal, replaced, head + tail >= words.size[a])
    return out


class Trie:
    """The levels of a trie over count vectors as sorted arrays, words in its leaves."""

    def __init__(self, words: Words, rows: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.base = words, int(counts.max(initial=0)) + 2
        node, self.levels = np.zeros(len(rows), np.int64), []
        for column in counts.T:
            keys, node = np.unique(node * self.base + column, return_inverse=True)
            self.levels.append(keys)
        size = words.size[rows]
        #: by (leaf, hash of a half): for words of equal length and for those one letter longer
        self.halves = {}
        for longer in (0, 1):
            half = (size - longer) // 2
            for side, a, b in (("first", 0 * size, half), ("last", half + longer, size)):
                key = self._key(node, words.part(rows, a, b))
                order = np.argsort(key, kind="stable")
                self.halves[longer, side] = key[order], rows[order]

    @staticmethod
    def _key(leaf: np.ndarray, part: np.ndarray) -> np.ndarray:
        return part ^ (leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def walk(self, rows: np.ndarray, counts: np.ndarray, spent: np.ndarray) -> Iterator[tuple]:
        """(words that ask, words found), depth first; near pairs are among them."""
        stack = [(0, np.arange(len(rows)), np.zeros(len(rows), np.int64), spent)]
        while stack:
            depth, who, node, used = stack.pop()
            if not len(who):
                continue
            if depth == len(self.levels):
                yield from self._leaves(rows[who], node, used)
                continue
            keys = self.levels[depth]
            for delta, allowed in ((-1, used == 1), (1, used == 0), (0, None)):
                some = np.arange(len(who)) if allowed is None else np.flatnonzero(allowed)
                count = counts[who[some], depth] + delta
                key = node[some] * self.base + count
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[place] == key) & (count >= 0) & (count < self.base)
                some, place = some[hit], place[hit]
                stack.append((depth + 1, who[some], place, used[some] + abs(delta)))

    def _leaves(self, rows: np.ndarray, leaf: np.ndarray, used: np.ndarray) -> Iterator[tuple]:
        words = self.words
        for longer in (0, 1):
            some = np.flatnonzero((used == 1) == bool(longer))
            asks = rows[some]
            size = words.size[asks]
            for side in ("first", "last"):
                half = size // 2
                a, b = (0 * size, half) if side == "first" else (half, size)
                keys, held = self.halves[longer, side]
                key = self._key(leaf[some], words.part(asks, a, b))
                low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                number = high - low
                for i, j in _slices(number):
                    many = number[i:j]
                    ask = np.repeat(asks[i:j], many)
                    shift = np.arange(len(ask)) - np.repeat(np.cumsum(many) - many, many)
                    yield ask, held[np.repeat(low[i:j], many) + shift], used[some][i:j].repeat(many)


def _slices(number: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges with about PAIRS pairs together."""
    total = np.concatenate([[0], np.cumsum(number)])
    i = 0
    while i < len(number):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
        if total[j] > total[i]:
            yield i, j
        i = j


PAIR = "a string, na bigint, b string, nb bigint"


def near_pairs(
    words: DataFrame, groups: int = GROUPS, levels: int = FIRST_LEVELS, node_words: int = NODE_WORDS
) -> DataFrame:
    """a, na, b, nb: each pair of different words of `words` (word, n; unique) that are one
    inserted, deleted or replaced letter apart, once. `words` is read several times."""
    of = letter_groups(words, groups)
    group_of = np.zeros(256, np.int64)
    for g, letters in enumerate(of):
        for letter in letters:
            group_of[ord(letter)] = g

    def search(rows: pa.Table) -> pa.Table:
        level = rows.column("level")[0].as_py()
        spent = rows.column("spent").to_numpy().astype(np.int64)
        n = rows.column("n").to_numpy()
        held = Words(rows.column("word").to_pylist())
        counts = held.counts(group_of, level, groups)
        own = np.flatnonzero(spent == 0)
        pairs = []
        if len(own):
            trie = Trie(held, own, counts[own])
            for start in range(0, len(spent), WALKERS):
                who = np.arange(start, min(start + WALKERS, len(spent)))
                for ask, found, used in trie.walk(who, counts[who], spent[who]):
                    # with equal vectors either could ask: the earlier row does
                    first = np.flatnonzero((used > 0) | (ask < found))
                    ask, found = ask[first], found[first]
                    good = _verified(held, ask, found)
                    pairs.append(ask[good] * len(spent) + found[good])
        # an insertion in the very middle leaves both halves equal
        both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        a, b = both // max(1, len(spent)), both % max(1, len(spent))
        word = rows.column("word").combine_chunks()
        return pa.table({"a": word.take(pa.array(a)), "na": n[a], "b": word.take(pa.array(b)), "nb": n[b]})

    return routed(words, of, levels, node_words).groupBy("node").applyInArrow(search, PAIR)


def variants(
    docs: DataFrame, least_n: int = LEAST_N, ratio: int = RATIO, groups: int = GROUPS,
    levels: int = FIRST_LEVELS, node_words: int = NODE_WORDS,
) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the corpus that occurs often enough."""
    words = stored(counted_words(docs).filter(F.col("n") >= least_n), "words")
    pairs = near_pairs(words, groups, levels, node_words)
    swap = lambda x, y: F.struct(
        F.col(x).alias("word"), F.struct((-F.col(f"n{y}")).alias("minus"), F.col(y).alias("form")).alias("near")
    )
    facts = (
        pairs.select(F.explode(F.array(swap("a", "b"), swap("b", "a"))).alias("p")).select("p.*")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    )
    takes = -F.col("best.minus") >= ratio * F.col("n")
    named = stored(
        words.join(facts, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(takes, F.col("best.form")).alias("form"),
            F.when(takes, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    roots = followed(named.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def followed(forms: DataFrame, doublings: int = DOUBLINGS) -> DataFrame:
    """word, root: the last word that the forms lead to. `forms`: word, root (its form).

    Each round replaces a root by its own root, so a round doubles the length of path that is followed;
    as n grows five times with each form, 2 ** 5 steps are more than any path of 64-bit counts has.
    """
    for _ in range(doublings):
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        forms = stored(
            forms.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
            "roots",
        )
    return forms


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE bytes AS (
    SELECT b, list_reduce([b::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) t(b)
), lookup AS (SELECT list(v ORDER BY b) AS crc FROM bytes
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
), lowered AS (
    SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM runs GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, strlen(doc || ':' || run)),
        lambda i: ('0x' || substr(hex(encode(doc || ':' || run)), 2 * i + 1, 2))::UBIGINT),
        lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h
    FROM lowered, lookup
), words AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
        ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), dropped AS (
    SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM dropped a JOIN dropped b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM dropped a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM dropped a JOIN words b ON a.rest = b.word
), near AS (
    SELECT word, count(*) AS n_near, arg_max(other, (other_n, -rank)) AS form, max(other_n) AS form_n
    FROM (SELECT *, row_number() OVER (ORDER BY encode(other)) AS rank FROM pairs) GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
        CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
    FROM words w LEFT JOIN near USING (word)
), paths AS (
    SELECT word, word AS root, 0 AS steps FROM forms
    UNION ALL SELECT p.word, f.form, steps + 1 FROM paths p JOIN forms f ON p.root = f.word WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(root, steps) AS root FROM paths GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
