"""N-gram Jaccard join of documents by adaptive multi-match prefixes.

Two documents link when their sets of five-word shingles have a Jaccard similarity of at least
``percent``. All sets are ordered by shingle hash. If two sets of at most n shingles share t or
more, then for every l the first n - t + l of each share at least l (the l-prefixes); t is
``percent`` of the document's own size here, which any partner must share.

1. Documents with equal sets form a class; only its least document goes on.
2. Each class emits its longest prefix, packed by ranges of the hash; a range's task keeps the
   tokens that two or more classes have, with their frequency.
3. A document lengthens its prefix by the cost its candidates would have: l grows with the
   frequencies in its 1-prefix, and on until fewer than l of its prefix tokens are frequent
   (in over ``frequent`` classes). Frequent tokens are then left out, as a partner shares another
   token still; for that, l is never above t. Documents made up of frequent tokens also meet each
   other by whole sets, in order of frequency among them, so that what makes one copy different
   comes first.
4. Each document is verified first against the leader that most of its tokens have: the document
   whose tokens have most documents on average, such as what others are copies of. That collapses groups of near copies without
   their pairs. Then the pairs that stand in different groups, and share as many tokens as both
   prefixes require, are verified by their whole sets.
5. Components of the links are labelled with their least document.

Classes are numbered, and everything between works on these numbers, so ids may be of any type that
can be compared. Every distinct set of shingles is a class of its own, whatever its rows' ids.

Scale: texts are hashed once; shuffled are the prefixes (a quarter of the shingles, 11 bytes each),
the shared tokens and the texts of candidates. No pair is made inside a group that leaders have
linked: of a token's documents, those outside its largest group meet the others. Tokens of over
``hot`` documents are dealt to several tasks. Verification is dealt by shared token, in blocks of
``block`` documents. A hash range's task holds its tokens' entries packed, so a range must fit a
task: ranges follow the number of shingles, and a token that a third of all classes keep in their
prefixes sets the least size of one. Intermediate tables are deleted at the end.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A text of fewer than five
words has its whole sequence as its one shingle.

Defined results: null and empty texts have no shingles and link with nothing; repeated rows and
equal texts link; rows that repeat an id are one document, so whatever links with one of its texts
links with all; rows without an id link as others do, and their component is its least id, null if
none has one; an empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm import words as W
from vectrail.llm.components import components
from vectrail.sources.scratch import Tables, tables, written

SHINGLE = 5
TIERS = 4
#: Rows of shared tokens.
ENTRIES = "token long, node long, n long, tier int, df long"
_ENTRY = np.dtype([("token", "<u8"), ("doc", "<u2"), ("tier", "u1")])


def least_shared(n, percent: int):
    return -(-percent * n // 100)


def longest_l(n):
    """The largest l that a document of ``n`` shingles stores; grows with n."""
    return 8 + n // 20


def tier_l(n: int, percent: int) -> list[int]:
    """The values of l that a document may choose. A partner has ``percent`` of its shingles at
    least, so stores a prefix as long, and may share no more than that, which bounds l."""
    top = longest_l(percent * n // 100)
    return [min(1 + (top - 1) * k // (TIERS - 1), least_shared(n, percent)) for k in range(TIERS)]


def stored(n, percent: int):
    """The length of the longest prefix."""
    return n - least_shared(n, percent) + longest_l(n)


def _sets(batch: pa.RecordBatch, text: str) -> list[np.ndarray]:
    words, bounds = W.hashed_words(W.texts_of(batch.column(text)))
    return [W.shingles(words[a:b], SHINGLE) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _marks(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    a = W.mix(own).sum(dtype=np.uint64)
    b = W.mix(own ^ W.U(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _described(rows: DataFrame, percent: int, whole: bool = False) -> DataFrame:
    """``rows`` without their text, with n, hi, lo and the tokens of the longest prefix (or of the
    ``whole`` set)."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _sets(batch, "text")
        marks = np.array([_marks(s) for s in own], np.int64).reshape(-1, 2)
        cut = [len(s) if whole else stored(len(s), percent) for s in own]
        arrays = [
            *(batch.column(f.name) for f in kept), pa.array([len(s) for s in own], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
            pa.array([s[:c].tobytes() for s, c in zip(own, cut, strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), "n", "hi", "lo", "tokens"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "n long, hi long, lo long, tokens binary"])
    return rows.mapInArrow(W.mapped(work, "text"), schema)


def _packed(classes: DataFrame, percent: int, bits: int) -> DataFrame:
    """(range, data): entries of all prefixes by range of the hash, with a table of their documents."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                yield from one(batch.slice(at, 8192))
        W.release()

    def one(batch: pa.RecordBatch):
        nodes = batch.column("node").to_numpy()
        sizes = batch.column("n").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
        if not sum(map(len, own)):
            return
        entries = np.empty(sum(map(len, own)), _ENTRY)
        entries["token"] = np.concatenate(own)
        entries["doc"] = np.repeat(np.arange(len(own)), [len(x) for x in own])
        tiers = []
        for x, n in zip(own, sizes.tolist(), strict=True):
            ends = [n - least_shared(n, percent) + l for l in tier_l(n, percent)]
            tiers.append(np.searchsorted(ends, np.arange(len(x)), side="right"))
        entries["tier"] = np.concatenate(tiers)
        place = (entries["token"] >> W.U(64 - bits)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        entries, place = entries[order], place[order]
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        ranges, blobs = [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(place)), strict=True):
            part = entries[a:b].copy()
            used, part["doc"] = np.unique(part["doc"], return_inverse=True)
            head = np.array([len(used), len(part)], np.int64)
            columns = (nodes[used].astype(np.int64), sizes[used].astype(np.int32), part["token"].copy(), part["doc"].copy(), part["tier"].copy())
            blobs.append(head.tobytes() + b"".join(c.tobytes() for c in columns))
            ranges.append(int(place[a]))
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(blobs, pa.binary())], ["range", "data"])

    return classes.select("node", "n", "tokens").mapInArrow(run, "range int, data binary")


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    docs, entries = np.frombuffer(blob, np.int64, 2).tolist()
    at, out = 16, []
    for kind, n in ((np.int64, docs), (np.int32, docs), (np.uint64, entries), (np.uint16, entries), (np.uint8, entries)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    nodes, sizes, token, doc, tier = out
    return token, nodes[doc], sizes[doc], tier


def _shared(table: pa.Table) -> pa.Table:
    """Entries of the tokens that two or more documents have."""
    parts = [_unpacked(x) for x in table.column("data").to_pylist()]
    token, node, n, tier = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(token, kind="stable")
    token = token[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    df = np.repeat(np.diff(np.append(first, len(token))), np.diff(np.append(first, len(token))))
    keep = df > 1
    order = order[keep]
    out = pa.table(
        {
            "token": pa.array(token[keep].view(np.int64)),
            "node": pa.array(node[order].astype(np.int64)),
            "n": pa.array(n[order].astype(np.int64)),
            "tier": pa.array(tier[order].astype(np.int32)),
            "df": pa.array(df[keep].astype(np.int64)),
        }
    )
    del parts, token, node, n, tier, order, first, df, keep
    W.release()
    return out


def _figures(shared: DataFrame, percent: int, frequent: int) -> DataFrame:
    """(node, n, choice, l, f, central): the tier that each document chooses, its l, the number f of
    frequent tokens in that prefix, and how many documents the tokens of the longest prefix have on
    average. A document of frequent tokens has no choice."""
    hot = F.col("df") > frequent
    top = 8 + F.floor(F.floor(F.lit(percent) * F.col("n") / 100) / 20)
    ls = [F.least(1 + F.floor((top - 1) * k / (TIERS - 1)), F.ceil(F.lit(percent) * F.col("n") / 100)) for k in range(TIERS)]
    figures = shared.groupBy("node").agg(
        F.first("n").alias("n"),
        F.sum("df").alias("met"),
        F.sum(F.when(~hot & (F.col("tier") == 0), F.col("df") - 1).otherwise(0)).alias("cost"),
        *[F.sum(F.when(hot & (F.col("tier") <= k), 1).otherwise(0)).alias(f"f{k}") for k in range(TIERS)],
    )
    wanted = F.when(F.col("cost") <= 4, 0).when(F.col("cost") <= 32, 1).when(F.col("cost") <= 256, 2).otherwise(3)
    choice = F.lit(None).cast("int")
    for k in reversed(range(TIERS)):
        choice = F.when((wanted <= k) & (F.col(f"f{k}") < ls[k]), k).otherwise(choice)
    size = F.least(F.col("n"), F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 8 + F.floor(F.col("n") / 20))
    return figures.withColumn("choice", choice).select(
        "node",
        "n",
        "choice",
        F.element_at(F.array(*ls), F.col("choice") + 1).alias("l"),
        F.element_at(F.array(*[F.col(f"f{k}") for k in range(TIERS)]), F.col("choice") + 1).alias("f"),
        F.round(F.col("met") / size, 3).alias("central"),
    )


def _emitted(shared: DataFrame, figures: DataFrame, frequent: int) -> DataFrame:
    """(token, node, n, df, l, f, central): what each document emits."""
    kept = (F.col("df") <= frequent) & (F.col("tier") <= F.coalesce("choice", F.lit(TIERS)))
    return shared.drop("n").join(figures, "node").where(kept).select("token", "node", "n", "df", "l", "f", "central")


def _of_frequent(texts: DataFrame, percent: int, bits: int, own: Tables) -> DataFrame:
    """The same of documents of frequent tokens among themselves: the 1-prefix of each whole set,
    ordered by frequency among these documents."""
    sets = _described(texts, percent, whole=True).select("node", "n", "tokens")
    shared = _packed(sets, percent, bits).groupBy("range").applyInArrow(_shared, ENTRIES)
    shared = own.written(shared.drop("tier"), "close-shared")
    unique = shared.groupBy("node").agg((F.first("n") - F.count(F.lit(1))).alias("unique"), F.round(F.sum("df") / F.first("n"), 3).alias("central"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - F.col("unique")
    ranked = shared.join(unique, "node").where(length > 0).withColumn("place", place).where(F.col("place") <= length)
    none = F.lit(None).cast("long")
    return ranked.select(
        "token", "node", "n", "df", none.alias("l"), none.alias("f"), "central",
        (F.col("n") - F.col("unique") - F.col("place") + 1).alias("left"), (F.col("n") - F.col("unique")).alias("common"),
    )


def _fits(a, b, percent: int):
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _texts(rows: DataFrame, classes: DataFrame, nodes: DataFrame, broadcast_ids: int) -> DataFrame:
    """(node, text) of some classes, from the row that stands for each."""
    ids = classes.join(nodes, "node", "left_semi").select("node", F.col("doc").alias("_d"), F.col("key").alias("_k"))
    if nodes.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    same = (F.col("key") == F.col("_k")) & F.col("doc").eqNullSafe(F.col("_d"))
    return rows.join(ids, same).groupBy("node").agg(F.min("text").alias("text"))


def _verified(texts, pairs: DataFrame, percent: int, block: int, own: Tables, label: str) -> DataFrame:
    """The pairs (a, b, token, df) that are similar enough by their whole sets; ``texts`` gives
    (node, text) of a table of nodes."""
    parts = F.ceil(F.col("df") / block)
    pairs = pairs.select(
        "a", "b", F.xxhash64("token", F.pmod(F.xxhash64("a"), parts), F.pmod(F.xxhash64("b"), parts)).alias("g")
    )
    pairs = own.written(pairs, f"{label}-pairs")
    needs = own.written(
        pairs.select("g", F.col("a").alias("node")).unionByName(pairs.select("g", F.col("b").alias("node"))).distinct(), f"{label}-needs"
    )
    sent = needs.join(texts(needs.select("node").distinct()), "node").select("g", "node", "text")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = dict(zip(right.column("node").to_pylist(), _sets(right.combine_chunks().to_batches()[0], "text") if right.num_rows else [], strict=True))
        found = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            if a in sets and b in sets:
                x, y = sets[a], sets[b]
                if len(x) > len(y):
                    x, y = y, x
                if len(x):
                    j = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[j] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append((a, b))
        out = pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})
        if right.nbytes > W.BLOCK:
            del sets
            W.release()
        return out

    links = pairs.groupBy("g").cogroup(sent.groupBy("g")).applyInArrow(check, "a long, b long")
    return own.written(links, f"{label}-links")


def _parts(size, hot: int):
    """The number of tasks that a token of ``size`` documents is dealt to."""
    return F.ceil(size / hot)


def _dealt(emitted: DataFrame, hot: int) -> DataFrame:
    """With the part of its token that a document is dealt to."""
    return emitted.withColumn("part", F.pmod(F.xxhash64("node"), _parts(F.col("df"), hot)))


def _in_parts(tokens: DataFrame, hot: int) -> DataFrame:
    """A row of (token, df) for each of its parts."""
    return tokens.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _parts(F.col("df"), hot) - 1))).drop("df")


def _led(emitted: DataFrame, percent: int, hot: int) -> DataFrame:
    """One pair for each document: with the leader that most of its tokens have."""
    leaders = emitted.groupBy("token").agg(F.max(F.struct("central", "node", "n")).alias("lead"), F.max("df").alias("df"))
    met = _dealt(emitted, hot).join(_in_parts(leaders, hot), ["token", "part"])
    met = met.where((F.col("lead.node") != F.col("node")) & _fits(F.col("n"), F.col("lead.n"), percent))
    met = met.groupBy("node", F.col("lead.node").alias("lead")).agg(
        F.count(F.lit(1)).alias("c"), F.min("token").alias("token"), F.max("df").alias("df")
    )
    best = met.groupBy("node").agg(F.max(F.struct("c", (-F.col("lead")).alias("m"), "lead", "token", "df")).alias("x"))
    return best.select(F.col("node").alias("a"), F.col("x.lead").alias("b"), F.col("x.token").alias("token"), F.col("x.df").alias("df"))


def _grouped(links: DataFrame, jumps: int = 3) -> DataFrame:
    """(node, grp) by following the links to leaders; what they leave apart is only verified once more."""
    up = links.select(F.col("a").alias("node"), F.col("b").alias("grp"))
    for _ in range(jumps):
        further = up.select(F.col("node").alias("grp"), F.col("grp").alias("further"))
        up = up.join(further, "grp", "left").select("node", F.coalesce("further", "grp").alias("grp"))
    return up


def _crossing(emitted: DataFrame, groups: DataFrame, percent: int, hot: int, whole: bool = False) -> DataFrame:
    """Pairs of different groups that share as many tokens as both prefixes require; unless
    ``whole``, without pairs of two documents of frequent tokens. If ``whole``, a pair's first
    shared token has to leave as many tokens behind it, and itself, as the pair must share, and
    neither can share tokens that no other document has. Of a token's documents, those outside its largest group meet all others."""
    marked = emitted.join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    tokens = marked.groupBy("token", "grp").agg(F.count(F.lit(1)).alias("size"), F.max("df").alias("df")).groupBy("token")
    tokens = tokens.agg(F.max(F.struct("size", "grp")).alias("x"), F.count(F.lit(1)).alias("groups"), F.max("df").alias("df"))
    several = tokens.where("groups > 1").select("token", F.col("x.grp").alias("most"), "df")
    marked = _dealt(marked, hot).join(_in_parts(several, hot), ["token", "part"])
    columns = ["node", "n", "grp", *(["common", "left"] if whole else ["l", "f"])]
    named = lambda df, s: df.select("token", "part", *[F.col(c).alias(f"{s}_{c}") for c in columns], *(["df"] if s == "a" else []), *(["most"] if s == "b" else []))
    a = marked.where(F.col("grp") != F.col("most")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _parts(F.col("df"), hot) - 1)))
    less = F.struct("a_n", "a_node") < F.struct("b_n", "b_node")
    met = named(a, "a").join(named(marked, "b"), ["token", "part"]).where(
        (F.col("a_grp") != F.col("b_grp")) & (less | (F.col("b_grp") == F.col("most"))) & _fits(F.col("a_n"), F.col("b_n"), percent)
    )
    if whole:
        for most in (F.least("a_common", "b_common"), F.least("a_left", "b_left")):
            met = met.where((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n")))
        need = F.lit(1)
    else:
        met = met.where("a_l is not null or b_l is not null")
        need = F.coalesce(F.least("a_l", "b_l") - F.least("a_f", "b_f"), F.lit(1))
    return (
        met.groupBy(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
        .agg(F.count(F.lit(1)).alias("c"), F.min(need).alias("need"), F.min("token").alias("token"), F.max("df").alias("df"))
        .where(F.col("c") >= F.greatest(F.col("need"), F.lit(1)))
        .select("a", "b", "token", "df")
    )


def _same_ids(described: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that rows of one id have."""
    own = described.where("doc is not null and n > 0").select("doc", "hi", "lo")
    mark = F.struct("hi", "lo")
    several = own.groupBy("doc").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x <> y").select("doc")
    nodes = own.join(several, "doc", "left_semi").distinct().join(classes.select("hi", "lo", "node"), ["hi", "lo"])
    first = nodes.groupBy("doc").agg(F.min("node").alias("b"))
    return nodes.join(first, "doc").select(F.col("node").alias("a"), "b").where("a <> b")


def join(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", percent: int = 80, frequent: int = 64,
    block: int = 256, broadcast_ids: int = 500_000, range_shingles: int = 4_000_000, hot: int = 256,
) -> DataFrame:
    """``doc``, n_shingles and component_id for every row."""
    rows = docs.select(F.col(f"`{doc}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    with tables() as own:
        described = own.written(_described(rows, percent), "described")
        total = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bits = max(6, int(log2(total / range_shingles + 1)) + 1)
        classes = described.where("n > 0").groupBy("hi", "lo").agg(
            F.min("doc").alias("least"), F.min(F.struct("key", "doc", "n", "tokens")).alias("x")
        ).select("hi", "lo", "least", "x.*")
        classes = own.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        shared = _packed(classes, percent, bits).groupBy("range").applyInArrow(_shared, ENTRIES)
        shared = own.written(shared, "shared")
        figures = own.written(_figures(shared, percent, frequent), "figures")
        emitted = own.written(_emitted(shared, figures, frequent), "emitted")
        texts = lambda nodes: _texts(rows, classes, nodes, broadcast_ids)
        verify = lambda pairs, name: _verified(texts, pairs, percent, block, own, name)
        led = verify(_led(emitted, percent, hot), "led")
        links = led.unionByName(verify(_crossing(emitted, _grouped(led), percent, hot), "crossing"))
        ids = figures.where("choice is null").select("node")
        if not ids.isEmpty():
            close = own.written(_of_frequent(texts(ids), percent, bits, own), "close")
            led = verify(_led(close, percent, hot), "led-close")
            links = links.unionByName(led).unionByName(verify(_crossing(close, _grouped(led), percent, hot, whole=True), "crossing-close"))
        links = links.unionByName(_same_ids(described, classes))

        roots = components(links, "roots")
        placed = classes.select("hi", "lo", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = placed.groupBy("root").agg(F.min("least").alias("component"))
        out = described.join(placed.join(least, "root").select("hi", "lo", "component"), ["hi", "lo"], "left")
        return written(
            out.select(
                F.col("doc").alias(doc),
                F.col("n").alias("n_shingles"),
                F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"),
            ),
            "joined",
        )


def deduplicated(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", broadcast_ids: int = 500_000, **options) -> DataFrame:
    """The documents without those of a component that aren't its least; all columns are kept,
    whatever their names. Of rows that repeat an id, one stays. Rows without an id stay."""
    found = join(docs, doc=doc, text=text, broadcast_ids=broadcast_ids, **options)
    id = F.col(f"`{doc}`")
    gone = written(found.where(id != F.col("component_id")).select(id.alias("_gone")).distinct(), "gone")
    if gone.count() <= broadcast_ids:
        gone = F.broadcast(gone)
    out = docs.join(gone, id == F.col("_gone"), "left_anti")
    ids = found.where(id.isNotNull())
    if ids.count() > ids.select(id).distinct().count():
        out = out.where(id.isNotNull()).dropDuplicates([doc]).unionByName(out.where(id.isNull()))
    return out
