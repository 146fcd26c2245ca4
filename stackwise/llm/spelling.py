"""Operator 12: spelling variants, words one edit apart, found by merging subtrees of tries.

Words are lower-cased (A-Z only) runs of letters of whole texts, counted in each task before anything is moved. Two words
that differ by one inserted, deleted or replaced character share the first half of the shorter one, or else its last half
and a bit: so each word goes to tries of words with its own beginning and, reversed, with its own end, once with words of
its length and the next, once with those one shorter. Every pair meets in exactly one trie that may report it.

Inside a trie (its sorted words; a node is a range of them and a depth) each node keeps its heaviest child where it is.
The leaves of the light children alone are merged into the rest, with the character at the node replaced or skipped: a
leaf below a light edge is looked up below the heavy edge, among the other light children's tails, and one level up. A
word crosses at most log2(size) light edges. A set of words with equal remains is one class: it gives each member the
number of the others and the most frequent of them, no list of pairs.

A trie of more than ``trie_words`` words is not given to one task: its top node is merged on Spark, by the remains that
its words have there (a class has at most one word for each character of the alphabet, twice), and its children become
tries of their own, until all are small.

Defined results: null and empty texts have no words; a null doc_id is an empty string before the colon when typos are
made; repeated rows and repeated ids count each time; a long text is read whole, one match at a time; a word's ties go to
the smallest form in code-point order; extra columns are ignored, whatever their names; an empty table gives an empty
result. Roots follow forms to the end: forms are at least ``ratio`` times as frequent, so chains end and have few links.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO, TYPO_EVERY = 6, 5, 5, 199
TRIE_WORDS = 50_000
FLUSH_WORDS, FLUSH_BYTES = 200_000, 16 << 20
COUNTS = "word string, n long"
ENTRIES = "side int, size int, depth int, word string, n long"
FOUND = "word string, n_near long, best struct<minus_n: long, form: string>"
BEST = pa.struct([("minus_n", pa.int64()), ("form", pa.string())])
MERGED = "side int, remains string, role int, word string, n long"


def document_words(doc_id: int | None, text: str, least: int = LEAST_LENGTH, typo_every: int = TYPO_EVERY) -> dict[str, int]:
    """Words of one text and their numbers, with the fixed typos that test data gets."""
    text = text.encode().lower().decode()  # bytes.lower() knows A-Z only
    runs = Counter(RUN.findall(text) if len(text) < 1 << 20 else (m[0] for m in RUN.finditer(text)))
    out: dict[str, int] = {}
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        if len(run) < least:
            continue
        h = zlib.crc32(run.encode(), start) if typo_every else 1
        if typo_every and h % typo_every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] = out.get(run, 0) + n
    return out


def counter(least: int, typo_every: int):
    def rows(found: dict[str, int]):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def step(batches):
        found: dict[str, int] = {}
        held = 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for word, n in document_words(doc_id, text or "", least, typo_every).items():
                    before = found.get(word)
                    if before is None:
                        held += len(word)
                        before = 0
                    found[word] = before + n
                if len(found) > FLUSH_WORDS or held > FLUSH_BYTES:
                    yield rows(found)
                    found, held = {}, 0
        if found:
            yield rows(found)

    return step


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo_every: int = TYPO_EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words of at least ``least`` characters and ``least_count`` occurrences; typo_every=0 makes no typos."""
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(counter(least, typo_every), COUNTS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def reports(side: int, size: int, word: str, depth: int) -> bool:
    """Whether the trie may report that ``word``, of size + 1 characters, without its character at ``depth`` is another
    word. A reversed trie leaves the pair to the other one if the words share their first half all the same."""
    if side == 0:
        return True
    run = depth
    while run and word[run - 1] == word[depth]:
        run -= 1
    return size - run < size // 2


class Near:
    """Numbers of near words and the best of them, for the words of one trie."""

    def __init__(self, words: list[str], counts: list[int], side: int):
        self.words, self.counts, self.side = words, counts, side
        self.number: dict[int, int] = defaultdict(int)
        self.best: dict[int, tuple[int, str]] = {}

    def _offer(self, i: int, j: int) -> None:
        form = self.words[j][::-1] if self.side else self.words[j]
        found = (-self.counts[j], form)
        if i not in self.best or found < self.best[i]:
            self.best[i] = found

    def pair(self, i: int, j: int) -> None:
        self.number[i] += 1
        self.number[j] += 1
        self._offer(i, j)
        self._offer(j, i)

    def alike(self, members: list[int]) -> None:
        """All members are near each other: each has the first of them as its best, the first has the second."""
        if len(members) < 2:
            return
        first, second = sorted(members, key=lambda i: (-self.counts[i], self.words[i][::-1] if self.side else self.words[i]))[:2]
        for i in members:
            self.number[i] += len(members) - 1
            self._offer(i, second if i == first else first)


def merge_trie(words: list[str], counts: list[int], side: int, size: int, depth: int) -> Near:
    """Merges the light subtrees of every node from ``depth`` on; words are sorted, of size or size + 1 characters."""
    near = Near(words, counts, side)

    def find(word: str, lo: int, hi: int) -> int:
        i = bisect_left(words, word, lo, hi)
        return i if i < hi and words[i] == word else -1

    nodes = [(0, len(words))]
    while nodes:
        lo, hi = nodes.pop()
        if hi - lo < 2:
            continue
        a, b = words[lo], words[hi - 1]
        d = depth
        while d < len(a) and a[d] == b[d]:
            d += 1
        children, at = [], lo + (len(a) == d)  # a word that ends at the node comes first
        while at < hi:
            end = bisect_right(words, words[at][d], at, hi, key=lambda w: w[d])
            children.append((at, end))
            at = end
        nodes.extend(children)
        heavy = max(children, key=lambda c: c[1] - c[0])
        h = words[heavy[0]][d]
        if len(a) == d and (i := find(a + h, *heavy)) >= 0 and reports(side, size, words[i], d):
            near.pair(lo, i)
        merged: dict[str, list[int]] = defaultdict(list)
        for child in children:
            if child == heavy:
                continue
            for i in range(*child):
                w = words[i]
                tail = w[d + 1 :]
                if len(w) == size:
                    merged[tail].append(i)  # replaced
                    if (j := find(f"{w[:d]}{h}{w[d:]}", *heavy)) >= 0 and reports(side, size, words[j], d):  # skipped in the heavy child
                        near.pair(i, j)
                elif tail[:1] != w[d] and reports(side, size, w, d) and (j := find(w[:d] + tail, lo, hi)) >= 0:  # skipped here
                    near.pair(i, j)
        for tail, members in merged.items():
            if (j := find(f"{a[:d]}{h}{tail}", *heavy)) >= 0:
                members.append(j)
            near.alike(members)
    return near


def merger(batches):
    """Tries from a stream of rows in the order of side, size, beginning and word; one trie at a time is held."""

    def close(trie, rows):
        side, size, depth = trie[:3]
        near = merge_trie([w for w, _ in rows], [n for _, n in rows], side, size, depth)
        for i, number in near.number.items():
            out["word"].append(near.words[i][::-1] if side else near.words[i])
            out["n_near"].append(number)
            out["best"].append({"minus_n": near.best[i][0], "form": near.best[i][1]})

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(out["word"], pa.string()), pa.array(out["n_near"], pa.int64()), pa.array(out["best"], BEST)], list(out))
        for column in out.values():
            column.clear()
        return batch

    out: dict[str, list] = {"word": [], "n_near": [], "best": []}
    now, rows = None, []
    for batch in batches:
        for *trie, word, n in zip(*(batch[c].to_pylist() for c in ("side", "size", "depth", "trie", "word", "n")), strict=True):
            if trie != now:
                if len(rows) > 1:
                    close(now, rows)
                now, rows = trie, []
            rows.append((word, n))
        if len(out["word"]) > FLUSH_WORDS // 10:
            yield flush()
    if len(rows) > 1:
        close(now, rows)
    yield flush()


def top_merger(batches):
    """The words of tries that are too large for a task, by what remains of them at the top node: role 0 with the
    character replaced, role 1 whole, role 2 with the character skipped."""
    for batch in batches:
        out: dict[str, list] = {"side": [], "remains": [], "role": [], "word": [], "n": []}
        for side, size, d, w, n in zip(*(batch[c].to_pylist() for c in ("side", "size", "depth", "word", "n")), strict=True):
            own = w[::-1] if side else w
            if len(w) == size:
                made = [(0, f"{size} {d} {w[:d]} {w[d + 1 :]}"), (1, f"{size} {d} {w}")] if d < size else [(1, f"{size} {d} {w}")]
            else:
                made = [(2, f"{size} {d} {w[:d]}{w[d + 1 :]}")] if d < len(w) and w[d + 1 : d + 2] != w[d] and reports(side, size, w, d) else []
            for role, remains in made:
                for column, value in zip(out.values(), (side, remains, role, own, n), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out["side"], pa.int32()), pa.array(out["remains"], pa.string()), pa.array(out["role"], pa.int32()), pa.array(out["word"], pa.string()), pa.array(out["n"], pa.int64())], list(out))


def _merged_tops(entries: DataFrame) -> DataFrame:
    """n_near and best of words that meet at the top node of a large trie."""
    made = entries.mapInArrow(top_merger, MERGED)
    whole = F.col("role") > 0
    one = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("form"))
    members = made.groupBy("side", "remains", whole.alias("whole")).agg(F.array_sort(F.collect_list(F.struct("role", one.alias("one")))).alias("m"))
    other = lambda x: F.when(
        ~F.col("whole"), F.element_at("m", F.when(x["one"] == F.element_at("m", 1)["one"], 2).otherwise(1))["one"]
    ).otherwise(F.when(x["role"] == 1, F.element_at("m", 2)["one"]).otherwise(F.element_at("m", 1)["one"]))
    # a class of replaced characters: all with all; else the whole word, first in order, with each that skips one
    n_near = lambda x: F.when(~F.col("whole") | (x["role"] == 1), F.size("m") - 1).otherwise(1)
    rows = members.where(F.size("m") > 1).where(~F.col("whole") | (F.element_at("m", 1)["role"] == 1))
    rows = rows.select(F.explode(F.transform("m", lambda x: F.struct(x["one"]["form"].alias("word"), n_near(x).cast("long").alias("n_near"), other(x).alias("best")))).alias("x"))
    return rows.select("x.*")


def near_words(words: DataFrame, trie_words: int = TRIE_WORDS, root: str | None = None) -> DataFrame:
    """word, n_near, best (-n and form of the most frequent near word) of the words that have near words; words: distinct
    word, n."""
    root = root or shared_dir(words.sparkSession)
    length = F.char_length("word")
    sizes = F.explode(F.array(length, length - 1)).alias("size")
    both = words.select("word", "n", sizes).where(F.col("size") >= F.lit(LEAST_LENGTH))
    half = F.floor(F.col("size") / 2).cast("int")
    forward = both.select(F.lit(0).alias("side"), "size", half.alias("depth"), "word", "n")
    backward = both.select(F.lit(1).alias("side"), "size", (F.col("size") - half).alias("depth"), F.reverse("word").alias("word"), "n")
    entries = forward.unionByName(backward).selectExpr("side", "size", "depth", "word", "n")
    trie = [F.col("side"), F.col("size"), F.col("depth"), F.substring("word", F.lit(1), F.col("depth")).alias("trie")]
    found, level = [], 0
    while True:
        sized = entries.groupBy(*trie).agg(F.count("*").alias("words"))
        large = materialise(sized.where(F.col("words") > trie_words), f"large{level}", root)
        marked = entries.select("*", trie[-1])
        keys = ["side", "size", "depth", "trie"]
        small = marked.join(large, keys, "left_anti")
        found.append(small.repartition(*keys).sortWithinPartitions(*keys, "word").mapInArrow(merger, FOUND))
        if large.isEmpty():
            break
        rest = materialise(marked.join(large.select(*keys), keys, "left_semi").select("side", "size", "depth", "word", "n"), f"level{level}", root)
        found.append(_merged_tops(rest))
        entries = rest.where(F.char_length("word") > F.col("depth")).withColumn("depth", F.col("depth") + 1)
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, root: str) -> DataFrame:
    """word, root for word, form without loops: each pass doubles the steps taken, in the shared folder."""
    known = materialise(forms.select("word", F.col("form").alias("root")), "roots0", root)
    for i in range(1, 64):
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        known = materialise(known.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), f"roots{i}", root)
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")
    raise RuntimeError("forms make a loop")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, typo_every: int = 0, trie_words: int = TRIE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs. typo_every plants typos, for tests of recall."""
    root = shared_dir(docs.sparkSession)
    words = materialise(word_counts(docs, LEAST_LENGTH, least_count, typo_every, id_col, text_col), "words", root)
    near = near_words(words, trie_words, root)
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus_n: long, form: string>").alias("best"))
    rows = rows.unionByName(near.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best"))
    rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    sure = -F.col("best.minus_n") >= ratio * F.col("n")
    rows = materialise(rows.select("word", F.when(sure, F.col("best.form")).alias("form"), "n", "n_near", F.when(sure, -F.col("best.minus_n")).alias("form_n")), "forms", root)
    ends = roots(rows.where("form is not null"), root)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), typo_every=TYPO_EVERY)
