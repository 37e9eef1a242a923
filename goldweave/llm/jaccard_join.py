"""N-gram Jaccard join: a size-aware heavy-light join over word shingles, and its components.

Texts become sets of hashed shingles; equal sets are one class.  Two classes link when
den * |intersection| >= num * |union|.  The join is exact in four steps.

1. Signature.  A set of n shingles must share a = ceil(n * num / den) with any partner.
   Its signature is its n - a + l smallest hashes, l = 2 + DEPTH * n, so partners have at
   least l (of the smaller) common hashes there.  Sets with fewer hashes that any other
   set has are alone and leave.  Of the others whole sets are made, and the same test,
   now for a shared hashes of all, is repeated while it still empties the lists.
2. Heavy and light.  On what is left, hashes are ordered from rare to frequent.  Small
   sets list the two-element subsets of their leading hashes, large sets are found by
   the inverted lists of single ones; the size that divides them has the least cost,
   estimated from list lengths.  Sets just below it are in both.
3. Stars, in rounds.  Every list takes a centre and compares it on whole sets with the
   members outside its component; links make components.  The first centre is the member
   whose elements the most other sets hold, so a group of near copies hangs on the text
   in its middle at once.  A centre has met its whole list and leaves it; a list of one
   component closes.  Later rounds take four times as many centres each, from the smallest
   components of a list first, until no list is open: then every pair that shares a list
   and could link is compared or lies in one component.
   A comparison needs room: elements from the list's own on that may be common.
   A long list is dealt over parts by its members; its centres go to every part.

Sets and hashes have 64-bit keys; two different ones share a key with odds of 2^-64.

Defined results: null or empty texts, and texts without words, have empty sets and link
with nothing; texts with fewer words than a shingle have one; repeated rows and equal
sets are one component; a null doc_id is ignored in the smallest id; an empty table gives
an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.ids import as_long, as_text, free_mark
from goldweave.llm.storage import discard, materialize
from goldweave.operators.graph import connected_components

#: Share of a set that its signature holds beyond the hashes of which one must be common.
DEPTH = 0.075
CHUNK_BYTES = 1 << 20
#: Sets of which a task remembers that it has given their signature; others are given again, and counted once.
REMEMBERED = 1 << 18
#: Cost of a subset that is listed, in list entries that are scanned.
SUBSET_COST = 2.0
#: Entries of a list that one task should meet; longer lists are dealt over parts.
LIST_PART = 512
#: Parts over which the documents of a component are dealt.
GROUP_PARTS = 1024
#: What a list says of a member.
MEMBER = ("set", "n", "room", "weight")

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the similarity num / den from which texts link."""

    words: int = 5
    num: int = 80
    den: int = 100

    def __post_init__(self) -> None:
        if not self.den < 2 * self.num <= 2 * self.den or self.words < 1:
            raise ValueError("a shingle needs a word, and a similarity lies above one half")

    def overlap(self, n):
        """Common elements that a set of n needs with any partner."""
        return -(-n * self.num // self.den)

    def common(self, n):
        """Common hashes in the signatures of partners of which the smaller has n."""
        return 2 + (n * DEPTH).astype(int) if isinstance(n, np.ndarray) else 2 + int(n * DEPTH)

    def signature(self, n: int) -> int:
        return min(n, n - self.overlap(n) + self.common(n))

    def can_link(self, n: int) -> bool:
        """Whether a set of n can link with a different set."""
        return self.den * n >= self.num * (n + 1) or self.den * (n - 1) >= self.num * n > 0

    def need_column(self, n: Column) -> Column:
        """Common hashes that a set of n has at least with any partner."""
        least = F.ceil(n * self.num / F.lit(self.den))
        return (F.floor(least * DEPTH) + 2).cast("long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    part: list[str | None] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= CHUNK_BYTES:
            yield from _shingle_chunk(part, words)
            part, held = [], 0
    if part:
        yield from _shingle_chunk(part, words)


def _shingle_chunk(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    buf = _LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    text_end = np.cumsum([len(r) + 1 for r in raw])
    with np.errstate(over="ignore"):
        if len(start):
            size = end - start
            first = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(first, size)
            powers = np.multiply.accumulate(np.full(int(size.max()), _BASE))
            letters = buf[~space].astype(np.uint64) + np.uint64(1)
            word = _mix(np.add.reduceat(letters * powers[place], first) + size.astype(np.uint64))
        else:
            word = np.zeros(0, np.uint64)
        bounds = np.searchsorted(start, np.r_[0, text_end])
        n = np.diff(bounds)
        total = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for j in range(words if len(total) else 0):  # no text of the chunk can have a whole shingle
            total += word[j : len(word) - words + 1 + j] * (_PLACE[j % 4] + np.uint64(2 * j))
        total = _mix(total)
        for i, count in enumerate(n):
            a = bounds[i]
            if count >= words:
                yield np.unique(total[a : a + count - words + 1])
            elif count:
                few = sum((word[a + j] * (_PLACE[j % 4] + np.uint64(2 * j)) for j in range(count)), np.uint64(count))
                yield _mix(np.array([few], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        mixed = _mix(hashes + _BASE)
        key = mixed.sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(mixed) * _PLACE[0] if len(mixed) else np.uint64(0))
        return int(_mix(np.array([key + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def text_sets(docs: DataFrame, rule: Rule, *carried: str) -> DataFrame:
    """(doc_id, set, n) of every row, and the long columns in ``carried``."""
    ids = ["doc_id", *carried]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(set_key(s), len(s)) for s in shingle_sets(list(pdf["text"]), rule.words)]
            out = pd.DataFrame(rows, columns=["set", "n"])
            for i, name in enumerate(ids):
                out.insert(i, name, pdf[name].to_numpy())
            yield out

    rows = as_text(docs.select(*ids, "text"), *ids)
    return as_long(rows.mapInPandas(run, ", ".join(f"{n} string" for n in ids) + ", set long, n long"), *ids)


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """(hash, set): the signature of every set that can link, mostly once for each task that meets it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            hashes, keys, sizes = [], [], []
            for s in shingle_sets(list(pdf["text"]), rule.words):
                key = set_key(s)
                if rule.can_link(len(s)) and key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    hashes.append(s[: rule.signature(len(s))])
                    keys.append(key)
                    sizes.append(len(hashes[-1]))
            if hashes:
                yield pd.DataFrame({"hash": np.concatenate(hashes).view(np.int64), "set": np.repeat(np.array(keys, np.int64), sizes)})

    return docs.select("text").mapInPandas(run, "hash long, set long")


def whole_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(set, n, hashes): all hashes of every set that can link, sorted as unsigned numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(set_key(s), len(s), s.view(np.int64)) for s in shingle_sets(list(pdf["text"]), rule.words) if rule.can_link(len(s))]
            yield pd.DataFrame(rows, columns=["set", "n", "hashes"])

    return docs.select("text").mapInPandas(run, "set long, n long, hashes array<long>")


def _several(rows: DataFrame) -> DataFrame:
    """``rows`` (hash, set), dealt by hash, whose hash is in more than one set."""
    several = rows.groupBy("hash").agg((F.min("set") != F.max("set")).alias("several")).filter("several").select("hash")
    return rows.join(several.hint("shuffle_hash"), "hash").distinct()


def _prune(shared: DataFrame, sizes: DataFrame, need: Column, rounds: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Sets with as many shared hashes as ``need`` (of n), and their shared hashes with df.

    What lonely sets leave behind is often shared no more, hence several rounds.
    """
    for _ in range(rounds):
        counts = shared.groupBy("set").agg(F.count("*").alias("shared"))
        alive = counts.join(sizes, "set").filter(F.col("shared") >= need)
        left = shared.select("hash", "set").join(alive.select("set"), "set", "left_semi")
        df = left.groupBy("hash").agg(F.count("*").alias("holders")).filter("holders > 1")
        older, shared = shared, materialize(left.join(df, "hash").select("hash", "set", F.col("holders").alias("df")), name)
        discard(older)
    counts = shared.groupBy("set").agg(F.count("*").alias("shared"))
    return materialize(counts.join(sizes, "set").filter(F.col("shared") >= need), name), shared


def surviving(docs: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(set, n, shared): sets whose signature shares enough with others."""
    shared = materialize(_several(signatures(docs, rule).repartition("hash")), "shared")
    return _prune(shared, sizes, rule.need_column(F.col("n")), 1, "signed")[0]


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n) * 4).cast("int")


def boundary(ranked: DataFrame) -> float:
    """The size up to which listing subsets costs less than scanning lists.

    A list entry costs its place in a list, log2 of the length; a subset costs SUBSET_COST.
    """
    per_set = ranked.groupBy("set").agg(F.first("n").alias("n"), F.count("*").alias("q"), F.sum(F.log2("df") + 1).alias("scan"))
    classes = per_set.groupBy(_size_class(F.col("n")).alias("c")).agg(F.sum(F.col("q") * (F.col("q") + 1) / 2).alias("subsets"), F.sum("scan").alias("scan"))
    rows = sorted(classes.collect())  # at most some hundred classes of sizes
    best, best_cost = 0.0, sum(r["scan"] for r in rows)
    for r in rows:
        cost = SUBSET_COST * sum(x["subsets"] for x in rows if x["c"] <= r["c"]) + sum(x["scan"] for x in rows if x["c"] >= r["c"] - 1)
        if cost < best_cost:
            best, best_cost = 2.0 ** ((r["c"] + 1) / 4), cost
    return best


def _dealt(lists: DataFrame) -> DataFrame:
    """``lists`` of two sets and more, each entry with ``parts`` of its list and its own ``part``.

    ``df`` says how long a list can be at most.  Where that is more than a part, even the
    search for lists of two sets is dealt over parts of that length.
    """
    several = (F.min("set") != F.max("set")).alias("several")
    entry = ("key", "parts", *MEMBER)
    short = lists.filter(F.col("df") <= LIST_PART)
    short = short.join(short.groupBy("key").agg(several).filter("several").select("key", F.lit(1).alias("parts")), "key").select(*entry).distinct()
    cell = F.pmod(F.xxhash64("set"), F.ceil(F.col("df") / LIST_PART)).alias("cell")
    long = materialize(lists.filter(F.col("df") > LIST_PART).select("*", cell), "long")
    lengths = long.groupBy("key").agg(several, F.ceil(F.count("*") / LIST_PART).cast("int").alias("parts")).filter("several").drop("several")
    cells = long.select("key", "cell").distinct().join(lengths, "key")
    rows = short.unionByName(long.join(cells, ["key", "cell"]).select(*entry).distinct())
    return rows.withColumn("part", F.pmod(F.xxhash64("set"), "parts").cast("int"))


def _each_part(keys: DataFrame) -> DataFrame:
    """``keys``, rows of whole lists, for every part of their list."""
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")


def candidate_lists(sets: DataFrame, rule: Rule) -> DataFrame:
    """(key, parts, part, set, n, room, weight): lists of which each pair of partners shares one at least.

    ``room`` is how many elements a set can have in common with a partner if the list
    stands for the first ones that they share; in that list it holds for every pair.
    ``weight`` is how many sets hold an element of the set, on average.
    """
    rows = sets.select("set", F.explode("hashes").alias("hash")).repartition("hash")
    sizes = sets.select("set", "n").distinct()
    need = F.ceil(F.col("n") * rule.num / F.lit(rule.den))
    alive, shared = _prune(materialize(_several(rows), "whole"), sizes, need, 3, "alive")
    entries = shared.join(alive, "set").groupBy("set").agg(
        F.first("n").alias("n"), F.first("shared").alias("shared"), F.sum("df").alias("holders"), F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("e")
    )
    entries = entries.withColumn("weight", (F.col("holders") / F.col("n")).cast("float")).drop("holders")
    ordered = materialize(entries.withColumn("q", (F.col("shared") - need + 1).cast("int")), "ordered")
    ranked = ordered.select("set", "n", "weight", "shared", F.posexplode(F.slice("e", F.lit(1), F.col("q"))).alias("i", "e"))
    ranked = ranked.select("set", "n", "weight", (F.col("shared") - F.col("i")).alias("room"), "e.*")
    limit = boundary(ranked)
    lists = ranked.filter(F.col("n") >= F.lit(limit * rule.num / rule.den) - 1).select(F.xxhash64("hash").alias("key"), "df", *MEMBER)
    if limit:
        few = ordered.filter(F.col("n") <= limit).withColumn("e", F.slice("e", F.lit(1), F.col("q") + 1))
        key = lambda x, y: F.xxhash64(F.least(x["hash"], y["hash"]), F.greatest(x["hash"], y["hash"])).alias("key")
        subset = lambda x, y, k: F.struct(key(x, y), x["df"].alias("df"), (F.col("shared") - k + 1).alias("room"))
        pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y, j: subset(x, y, i + 1 + j))))
        lists = lists.unionByName(few.select(F.explode(pairs).alias("p"), "set", "n", "weight").select("p.key", "p.df", "set", "n", "p.room", "weight"))
    return materialize(_dealt(lists), "lists")


def _possible(n: Column, m: Column, room: Column, other: Column, rule: Rule) -> Column:
    """Whether sets of n and m can link with so much room each."""
    return (F.least(room, other) * (rule.num + rule.den) >= (n + m) * rule.num) & (n * rule.den >= m * rule.num) & (m * rule.den >= n * rule.num)


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    one = pairs.join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("right")), "b")
    both = one.join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("left")), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf["left"], pdf["right"], strict=True)):
                a, b = np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64)
                at = np.searchsorted(a, b)
                at[at == len(a)] = 0
                common = int((a[at] == b).sum())
                keep[i] = rule.den * common >= rule.num * (len(a) + len(b) - common)
            yield pdf.loc[keep, ["a", "b"]]

    return both.select("a", "b", "left", "right").mapInPandas(run, "a long, b long")


def set_links(docs: DataFrame, sizes: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Links between sets that join all that belong together, and the components of the sets."""
    signed = surviving(docs, sizes.select("set", "n").distinct(), rule)
    wanted = sizes.join(signed.select("set"), "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    sources = docs.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi")
    nameless = docs.select("doc_id", "text").filter(F.col("doc_id").isNull())
    sets = materialize(whole_sets(sources.unionByName(nameless), rule), "sets")
    lists = candidate_lists(sets, rule)

    return stars(lists, sets, rule)


def _centres(open_lists: DataFrame, many: int) -> DataFrame:
    """(key, parts, c): the next centres of every list, those of small components first.

    Of each component only as many members as there are centres are looked at, chosen
    before rows are dealt, so that a list of one large component meets in no task.
    """
    if many == 1:
        return open_lists.groupBy("key").agg(F.max("parts").alias("parts"), F.max(F.struct("weight", "set", "n", "room", "group")).alias("c"))
    inside = open_lists.groupBy("key", "group").agg(F.count("*").alias("inside"))
    best = Window.partitionBy("key", "group").orderBy(F.desc("weight"), "set")
    able = open_lists.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= many)
    first = Window.partitionBy("key").orderBy("inside", F.desc("weight"), "set")
    chosen = able.join(inside, ["key", "group"]).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= many)
    return chosen.select("key", "parts", F.struct("weight", "set", "n", "room", "group").alias("c"))


def stars(lists: DataFrame, sets: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Links that join all sets that belong together, and (node, component) of the linked sets."""
    open_lists, many, links, met, groups = lists.withColumn("group", F.col("set")), 1, None, None, None
    while True:
        centres = _centres(open_lists, many)
        if many > 1:  # used once more below, and few
            centres = materialize(centres, "centres")
        able = _possible(F.col("n"), F.col("c.n"), F.col("room"), F.col("c.room"), rule)
        new = open_lists.join(_each_part(centres), ["key", "part"]).filter((F.col("group") != F.col("c.group")) & able)
        new = new.select(F.least("c.set", "set").alias("a"), F.greatest("c.set", "set").alias("b")).distinct()
        new = materialize(new if met is None else new.join(met, ["a", "b"], "left_anti"), "pairs")
        found = materialize(verified(new, sets, rule), "links")
        links, met = (found, new) if met is None else (links.unionByName(found), met.unionByName(new))
        groups = _relabelled(groups, found) if groups is None or not found.isEmpty() else groups

        left = open_lists.drop("group").join(centres.select("key", F.col("c.set").alias("set")), ["key", "set"], "left_anti")
        named = left.join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("group", F.coalesce("component", "set")).drop("component")
        mixed = named.groupBy("key").agg((F.min("group") != F.max("group")).alias("mixed"), F.max("parts").alias("parts")).filter("mixed").drop("mixed")
        older, open_lists = open_lists, materialize(named.join(_each_part(mixed), ["key", "part"]), "open")
        discard(older, centres)
        if open_lists.isEmpty():
            return links, groups
        many *= 4


def _relabelled(groups: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, component) when the links ``found`` join what ``groups`` has so far; edges are pairs of components."""
    edges = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if groups is None:
        return materialize(connected_components(edges), "groups")
    for end in ("u", "v"):
        named = groups.select(F.col("node").alias(end), F.col("component").alias("label"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    joined = materialize(connected_components(edges), "joined")
    old = groups.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    old = old.select("node", F.coalesce("to", "component").alias("component"))
    return materialize(old.unionByName(joined.join(old.select("node"), "node", "left_anti").select("node", "component")), "groups")


def _grouped(sizes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """``sizes`` with ``group``, the component of the set; null for texts without words."""
    _, groups = set_links(docs, sizes, rule)
    named = sizes.join(groups.withColumnRenamed("node", "set"), "set", "left")
    return named.withColumn("group", F.when(F.col("n") > 0, F.coalesce("component", "set"))).drop("component")


def join_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component) of every row.

    The smallest id of a component is found and handed back by parts of it, so that no
    task meets all rows of a component, nor all texts without words.
    """
    named = _grouped(materialize(text_sets(docs, rule), "sizes"), docs, rule)
    named = materialize(named.withColumn("cell", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(GROUP_PARTS))), "components")
    cells = named.filter("n > 0").groupBy("group", "cell").agg(F.min("doc_id").alias("least"))
    cells = cells.withColumn("least", F.min("least").over(Window.partitionBy("group")))
    out = named.join(cells, ["group", "cell"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of ``docs`` for each component, the one with the smallest doc_id; texts without words all stay.

    A row is known by its doc_id and its text: of rows that share a doc_id, those with other
    texts are judged by their own components, and repeated ones count once.  A null doc_id
    comes after all others.
    """
    mark = free_mark(docs.columns, "_text_key")
    rows = docs.withColumn(mark, F.xxhash64("text"))
    named = _grouped(materialize(text_sets(rows, rule, mark), "sizes"), docs, rule).filter("n > 0")
    named = materialize(named.select("doc_id", mark, "group"), "components")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", mark)
    first = named.groupBy("group").agg(F.min(place).alias("first")).select(F.col("first.doc_id").alias(f"{mark}_id"), F.col(f"first.{mark}").alias(f"{mark}_of"), F.lit(True).alias(f"{mark}_first"))
    found = rows.join(first, F.col("doc_id").eqNullSafe(F.col(f"{mark}_id")) & (F.col(mark) == F.col(f"{mark}_of")), "left")
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = found.filter(F.col(f"{mark}_first") | wordless).select(*rows.columns)
    if not named.groupBy("doc_id", mark).count().filter("count > 1").isEmpty():
        again = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*docs.columns)))
        left = left.withColumn(f"{mark}s", again).filter((F.col(f"{mark}s") == 1) | wordless)
    return left.select(*docs.columns)
