"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

One replaced letter leaves a word's length and moves its letter counts by one down and one
up; one inserted letter moves one count up. So words of one length are searched twice: by
the words of that length for replacements, by those one letter shorter for insertions. A
tree splits the words at a letter's count; a search follows the own side, and the other
side only while the way to that box still costs one count down and one up at most. The
letter lost must come before the letter won, so each pair is found from one side only.
What is left is compared letter by letter.

In Spark, a coarse tree per length (fitted on a bounded sample of the words; it decides
only where a word is compared, never whether) deals the words into cells. Each word lies
in one cell and visits the cells its edits can reach. Cells that are too full are dealt
out by a hash of their words, and visits go to each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agriclime.llm.common import small
from agriclime.sources.tables import materialize

LEAST_LETTERS = 7
LEAST_COUNT = 2
# One in so many occurrences loses a letter.
TYPO_ONE_IN = 31
# A form is at least so many times as frequent.
FORM_TIMES = 10
# The coarse trees are fitted on so many words, the least by hash.
SAMPLE = 50_000
# A cell holds about so many words (of up to 64 letters; fewer, if longer).
CELL_WORDS = 32_768
# Words in a leaf of the trees inside a cell, and letters compared at once.
LEAF = 8
STEP_LETTERS = 1 << 24
STEP_WORDS = 4096

LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.int64)
_INDEX = np.full(256, -1, np.int64)
_INDEX[LETTERS] = np.arange(len(LETTERS))


def letters(words: list[str]) -> np.ndarray:
    """A row of code points for each word; all words have one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    n, length = codes.shape
    flat = np.arange(n)[:, None] * len(LETTERS) + _INDEX[codes]
    kind = np.uint8 if length < 256 else np.int32
    return np.bincount(flat.ravel(), minlength=n * len(LETTERS)).astype(kind).reshape(n, len(LETTERS))


class Tree:
    """A k-d tree over rows of letter counts. Words with more than ``bound`` of a node's
    ``letter`` are on its right; a node without children is a leaf, a range of ``order``."""

    def __init__(self, counts: np.ndarray, leaf: int):
        self.order = np.arange(len(counts))
        letter, bound, left, right, span = [], [], [], [], []
        todo = [(0, len(counts), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(letter)
            if parent >= 0:
                (left, right)[side][parent] = node
            for column, value in ((letter, -1), (bound, 0), (left, -1), (right, -1), (span, (a, b))):
                column.append(value)
            if b - a > leaf and (cut := self._cut(counts[self.order[a:b]])):
                letter[node], bound[node] = cut
                rows = self.order[a:b]
                over = counts[rows, cut[0]] > cut[1]
                middle = a + int(np.count_nonzero(~over))
                self.order[a:b] = np.concatenate([rows[~over], rows[over]])
                todo += [(middle, b, node, 1), (a, middle, node, 0)]
        self.letter, self.bound = np.array(letter), np.array(bound)
        self.left, self.right, self.span = np.array(left), np.array(right), np.array(span)

    @staticmethod
    def _cut(counts: np.ndarray) -> tuple[int, int] | None:
        """The letter and bound that split the words most evenly."""
        n, best, cut = len(counts), 0, None
        for bound in (0, 1, 2):
            over = np.count_nonzero(counts > bound, axis=0)
            even = np.minimum(over, n - over)
            at = int(np.argmax(even))
            if even[at] > best:
                best, cut = int(even[at]), (at, bound)
        if cut is None:  # long words: counts that differ are all over 3
            low, high = counts.min(0), counts.max(0)
            at = int(np.argmax(high - low))
            if high[at] > low[at]:
                cut = at, int((int(low[at]) + int(high[at])) // 2)
        return cut

    def search(self, counts: np.ndarray, replace: bool, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves that hold words one replacement (else insertion) away.

        ``own``: only the leaf where a word of these counts lies.
        """
        row = np.arange(len(counts))
        node, up, down = np.zeros_like(row), np.full_like(row, -1), np.full_like(row, -1)
        rows, leaves = [], []
        while len(row):
            letter = self.letter[node]
            ends = letter < 0
            if ends.any():
                rows.append(row[ends])
                leaves.append(node[ends])
                row, node, up, down, letter = (x[~ends] for x in (row, node, up, down, letter))
            moved_up, moved_down = up == letter, down == letter
            here = counts[row, letter].astype(np.int64) + moved_up - moved_down
            bound = self.bound[node]
            over = here > bound
            nearer = np.where(over, self.right[node], self.left[node])
            if own:
                node = nearer
                continue
            free = ~moved_up & ~moved_down
            rise = free & (here == bound) & (up < 0) & ((down < 0) | (letter > down))
            fall = free & (here == bound + 1) & (down < 0) & ((up < 0) | (letter < up)) if replace else np.zeros_like(rise)
            row_, node_ = row, node
            row = np.concatenate([row_, row_[rise], row_[fall]])
            node = np.concatenate([nearer, self.right[node_[rise]], self.left[node_[fall]]])
            up, down = (
                np.concatenate([up, letter[rise], up[fall]]),
                np.concatenate([down, down[rise], letter[fall]]),
            )
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *leaves])


def one_apart(query: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Row by row: one replaced letter, the smaller in ``query``; or one inserted in ``word``."""
    if query.shape[1] == word.shape[1]:
        differ = query != word
        at = differ.argmax(1)
        rows = np.arange(len(query))
        return (np.count_nonzero(differ, axis=1) == 1) & (query[rows, at] < word[rows, at])
    first, last = query != word[:, :-1], (query != word[:, 1:])[:, ::-1]
    prefix = np.where(first.any(1), first.argmax(1), query.shape[1])
    suffix = np.where(last.any(1), last.argmax(1), query.shape[1])
    return prefix + suffix >= query.shape[1]


class Cell:
    """The words of one cell in a tree, with their frequencies."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n, self.codes = words, n, letters(words)
        self.tree = Tree(letter_counts(self.codes), LEAF)
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.argsort(np.array([w.encode("latin-1") for w in words], object), kind="stable")] = np.arange(len(words))

    def near(self, words: list[str], n: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
        """(word, near words, largest n of them, the least such word), for both sides of all
        pairs, of the queries and of this cell's words, one or more rows each."""
        codes = letters(words)
        row, leaf = self.tree.search(letter_counts(codes), codes.shape[1] == self.codes.shape[1])
        start, sizes = self.tree.span[leaf, 0], self.tree.span[leaf, 1] - self.tree.span[leaf, 0]
        ends = np.cumsum(sizes)
        step, pairs, at = max(1, STEP_LETTERS // self.codes.shape[1]), [], 0
        while at < len(row):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + step, "right")))
            size = sizes[at:stop]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            query = np.repeat(row[at:stop], size)
            word = self.tree.order[np.repeat(start[at:stop], size) + inner]
            good = one_apart(codes[query], self.codes[word])
            pairs.append((query[good], word[good]))
            at = stop
        if not pairs:
            return
        query, word = (np.concatenate(side) for side in zip(*pairs))
        query_rank = np.empty(len(words), np.int64)
        query_rank[np.argsort(np.array([w.encode("latin-1") for w in words], object), kind="stable")] = np.arange(len(words))
        yield from _best(query, word, self.n[word], self.rank[word], words, self.words)
        yield from _best(word, query, n[query], query_rank[query], self.words, words)


def _best(of, other, n, rank, of_words, other_words):
    order = np.lexsort((rank, -n, of))
    of, other, n = of[order], other[order], n[order]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    for a, b in zip(starts, np.r_[starts[1:], len(of)]):
        yield of_words[of[a]], int(b - a), int(n[a]), other_words[other[a]]


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of at least 7 letters and their occurrences (2 at least).

    Runs of A-Z, a-z and U+00C0 to U+00FF are lower-cased in A-Z alone. An occurrence whose
    crc32 of ``key:run`` is divisible by 31 loses the code point at crc32 % length. A null
    text has no words, a null key is an empty one.
    """
    upper = "".join(map(chr, range(65, 91)))
    # Shorter runs cannot give words of the least length.
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit("([A-Za-zÀ-ÿ]{%d,}+)" % LEAST_LETTERS), F.lit(1))
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(runs).alias("r"))
    rows = rows.select("k", F.translate("r", upper, upper.lower()).alias("r"))
    rows = rows.select("r", F.crc32(F.concat("k", F.lit(":"), "r").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("r")).cast("int")
    shorter = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    word = F.when(F.col("h") % TYPO_ONE_IN == 0, shorter).otherwise(F.col("r"))
    return (
        rows.select(word.alias("word"))
        .where(F.length("word") >= LEAST_LETTERS)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def coarse_trees(words: DataFrame, sample: int = SAMPLE, cell_words: int = CELL_WORDS) -> dict[int, Tree]:
    """A tree for each length of the sample; its leaves are the cells."""
    drawn = [r[0] for r in words.orderBy(F.xxhash64("word"), "word").select("word").limit(sample).collect()]
    share = len(drawn) / max(1, words.count())
    by_length: dict[int, list[str]] = {}
    for w in drawn:
        by_length.setdefault(len(w), []).append(w)
    made = {}
    for length, group in by_length.items():
        tree = Tree(letter_counts(letters(group)), max(32, int(share * cell_words)) if share < 1 else cell_words)
        tree.order = None  # the sample itself is not needed
        made[length] = tree
    return made


def _cells(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """A row for each word in its cell (``visit`` 0) and in each cell that it visits (1)."""
    shared = words.sparkSession.sparkContext.broadcast(trees)
    schema = "length int, leaf int, visit int, word string, n long"

    def run(batches):
        trees = shared.value

        def routed(target, counts, replace, own):
            tree = trees.get(target)
            if tree is None:
                return np.arange(len(counts)), np.zeros(len(counts), np.int64)
            return tree.search(counts, replace, own)

        for batch in batches:
            length = np.array([len(w) for w in batch.column("word").to_pylist()])
            for l in np.unique(length):
                at = np.flatnonzero(length == l)
                part = batch.take(pa.array(at))
                counts = letter_counts(letters(part.column("word").to_pylist()))
                for target, replace, own in ((l, True, True), (l, True, False), (l + 1, False, False)):
                    row, leaf = routed(int(target), counts, replace, own)
                    taken, n = part.take(pa.array(row)), len(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, target, np.int32)),
                            pa.array(leaf.astype(np.int32)),
                            pa.array(np.full(n, 0 if own else 1, np.int32)),
                            taken.column("word"),
                            taken.column("n"),
                        ],
                        ["length", "leaf", "visit", "word", "n"],
                    )

    return words.select("word", F.col("n").cast("long")).mapInArrow(run, schema)


def _compare(cells: DataFrame) -> DataFrame:
    """Near words of all cells, by word: several rows each."""
    key = ["length", "leaf", "part"]

    def run(batches):
        now, cell, words, n, asked, asked_n = None, None, [], [], [], []

        def flush():
            nonlocal cell, asked, asked_n
            if cell is None and words:
                cell = Cell(words, np.array(n, np.int64))
            if cell is not None:
                for k in (0, 1):
                    group = [i for i, w in enumerate(asked) if (len(w) == now[0]) == bool(k)]
                    if group:
                        yield from cell.near([asked[i] for i in group], np.array([asked_n[i] for i in group], np.int64))
            asked, asked_n = [], []

        def batch_of(rows):
            if rows:
                return [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["word", "n_near", "form_n", "form"])]
            return []

        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in (*key, "visit", "word", "n")]
            for *place, visit, word, many in zip(*columns):
                if place != now:
                    rows += flush()
                    now, cell, words, n = place, None, [], []
                if visit:
                    asked.append(word)
                    asked_n.append(many)
                    if len(asked) >= STEP_WORDS or len(asked) * len(word) >= STEP_LETTERS:
                        rows += flush()
                else:
                    words.append(word)
                    n.append(many)
            yield from batch_of(rows)
        yield from batch_of(list(flush()) if now else [])

    spark = cells.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cells.repartition(tasks, *key).sortWithinPartitions(*key, "visit", "word")
    return dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")


def near_words(words: DataFrame, sample: int = SAMPLE, cell_words: int = CELL_WORDS) -> DataFrame:
    """For each word with near words: ``n_near``, and the most frequent one (ties: the least
    in code-point order) as ``form`` with ``form_n``. ``words`` is a stored table of distinct
    ``word`` and ``n``."""
    cells = materialize(_cells(words, coarse_trees(words, sample, cell_words)), "variant-cells")
    size = F.count("*") * F.greatest(F.lit(64), F.col("length"))
    parts = cells.where("visit = 0").groupBy("length", "leaf").agg(F.ceil(size / (64 * cell_words)).cast("int").alias("parts"))
    parts = materialize(parts.where("parts > 1"), "variant-full")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = cells.join(small(parts), ["length", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("visit") == 0, own).otherwise(every))).drop("parts")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form")))
    found = _compare(dealt).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(``word``, ``root``) from a stored table of (``word``, ``form``): forms followed to the
    last. A form is ten times as frequent, so chains are short; each round doubles the way."""
    ends = links.select("word", F.col("form").alias("root"))
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        if not ends.join(onward, "root", "left_semi").limit(1).count():
            return ends
        ends = materialize(
            ends.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots"
        )


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, cell_words: int = CELL_WORDS) -> DataFrame:
    """Words, their near words and spellings: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Near words differ by one inserted, deleted or replaced code point. ``form`` is the near
    word of largest n (ties: the smallest in code-point order) if it is ten times as frequent,
    else null, like ``form_n``; ``root`` is the last of the chain of forms, or the word.
    Nulls and the words themselves: see ``count_words``. Repeated rows count each. Other
    columns are not read; an empty table gives no rows.
    """
    words = materialize(count_words(df, key, text), "words")
    found = words.join(near_words(words, sample, cell_words), "word", "left")
    enough: Column = F.col("form_n") >= FORM_TIMES * F.col("n")
    found = materialize(
        found.select(
            "word", "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("form")).alias("form"),
            F.when(enough, F.col("form_n")).alias("form_n"),
        ),
        "variants",
    )
    last = roots(found.where("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
