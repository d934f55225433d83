"""N-gram Jaccard join of whole texts by rare-first prefix filtering.

Flow.  Blocks of texts send sorted arrays of (shingle, text) to hash ranges of the shingles; each range counts in
how many texts a shingle stands and answers with the shared ones (two texts or more).  A shingle of a single text
can link nothing, so from there on a text is its size and its shared shingles in the global order, rarest first.
Texts whose shared part is below the threshold leave.  Exact copies become one class.  Prefix shingles of the
classes are joined; pairs pass the length, positional and suffix filters and are verified once each by intersection.

Linked texts need only be connected, so each posting list is first compared with one centre (a star), lists that
lie within one component are finished, and after a few rounds the texts that open lists still connect are compared block
by block, each block pair giving only links that join components: every link between different texts is covered, and
no group of copies becomes a square of rows.

Edge cases.  Null and empty texts: size 0, linked with nothing, component_id their own id.  Fewer words than k: the
whole sequence is one shingle.  A null id: the text takes part, component_id is the smallest non-null id of its
component or null.  Repeated rows are copies like others.  An empty table gives an empty result.  Other columns are
not read.  Shingles are compared by 48-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import store
from dovetail.llm.blobs import gaps, pack, tidied, tidy, ungap, unpack
from dovetail.llm.text import U64, chunks, mix, shingles, words

KEY_BITS, DOC_BITS = 48, 16
#: A block of texts that one task holds at once.
BLOCK_BYTES, BLOCK_DOCS = 12 << 20, 1 << DOC_BITS
#: A shingle in so many texts of one block goes out as one count; its texts stay with their block.
HEAVY = 16
PART_BYTES = 24 << 20
BUCKETS = 16
STAR_ROUNDS = 2
#: A posting list of so many texts, by its count, is dealt to one more task.
LIST = 256
#: Texts of a block when a cluster is compared block by block.
GROUP = 512


def _emitter(k: int, n_parts: int):
    edges = np.array([((p << KEY_BITS) // n_parts) << DOC_BITS for p in range(1, n_parts)], U64)

    def flush(block: int, combos: list, ids: list, known: list, tags: list):
        n_docs = sum(map(len, ids))
        both = np.sort(np.concatenate(combos)) if combos else np.zeros(0, U64)
        if len(both):
            both = both[np.concatenate(([True], both[1:] != both[:-1]))]
        key, doc = both >> U64(DOC_BITS), (both & U64(BLOCK_DOCS - 1)).astype(np.int64)
        size = np.bincount(doc, minlength=n_docs)
        h1, h2 = np.zeros(n_docs, U64), np.zeros(n_docs, U64)
        mixed = mix(key)
        np.add.at(h1, doc, mixed)
        np.add.at(h2, doc, mix(mixed ^ U64(0x5851F42D4C957F2D)))
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        runs = np.diff(np.append(begins, len(key)))
        heavy = np.repeat(runs >= HEAVY, runs)
        light, hot = both[~heavy], both[heavy]
        hot_keys, hot_counts = key[begins[runs >= HEAVY]], runs[runs >= HEAVY].astype(np.uint32)
        a, b = np.searchsorted(light, edges), np.searchsorted(hot_keys, edges >> U64(DOC_BITS))
        a, b = [0, *a, len(light)], [0, *b, len(hot_keys)]
        for p in range(n_parts):
            if a[p] < a[p + 1] or b[p] < b[p + 1]:
                yield p, block, 0, pack(gaps(light[a[p] : a[p + 1]]), gaps(hot_keys[b[p] : b[p + 1]]), hot_counts[b[p] : b[p + 1]])
        yield block % n_parts, block, 1, pack(np.concatenate(ids), np.concatenate(known), np.concatenate(tags), size.astype(np.int64), h1, h2, gaps(hot))

    def rows(batches):
        block = TaskContext.get().partitionId() << 24
        combos, ids, known, tags, n_docs, n_bytes = [], [], [], [], 0, 0
        for batch in batches:
            id_column = batch.column(0)
            valid = np.array(id_column.is_valid())
            numbers = id_column.fill_null(0).to_numpy(zero_copy_only=False)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in chunks(batch.column(1)):
                if n_docs and (n_docs + hi - lo > BLOCK_DOCS or n_bytes + len(data) > BLOCK_BYTES):
                    yield from flush(block, combos, ids, known, tags)
                    block += 1
                    combos, ids, known, tags, n_docs, n_bytes = [], [], [], [], 0, 0
                s, d = shingles(*words(data, at), k)
                combos.append(s >> U64(64 - KEY_BITS) << U64(DOC_BITS) | (d + n_docs).astype(U64))
                ids.append(numbers[lo:hi])
                known.append(valid[lo:hi].astype(np.uint8))
                tags.append(marks[lo:hi])
                n_docs, n_bytes = n_docs + hi - lo, n_bytes + len(data)
        if n_docs:
            yield from flush(block, combos, ids, known, tags)

    def run(batches):
        for p, block, kind, blob in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], ["part", "block", "kind", "blob"])

    return run


def _count_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one range of shingles: those in two texts or more, back to each block with their counts."""
    out = [(b, 1, x) for b, k, x in zip(pdf["block"], pdf["kind"], pdf["blob"], strict=True) if k == 1]
    took = [(b, *unpack(x)) for b, k, x in zip(pdf["block"], pdf["kind"], pdf["blob"], strict=True) if k == 0]
    if took:
        blocks = [x[0] for x in took]
        light, hot = [ungap(x[1]) for x in took], [ungap(x[2]) for x in took]
        one = np.concatenate(light) >> U64(DOC_BITS)
        n_light = len(one)
        every = np.concatenate([one, *hot])
        weight = np.concatenate([np.ones(n_light, np.int64), *[x[3].astype(np.int64) for x in took]])
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        total = np.add.reduceat(weight[order], begins)
        count = np.empty(len(every), np.int64)
        count[order] = np.repeat(total, np.diff(np.append(begins, len(every))))
        count = np.minimum(count, 32767).astype(np.uint16)
        at, up = 0, n_light
        for b, x, y in zip(blocks, light, hot, strict=True):
            mine, theirs = count[at : at + len(x)], count[up : up + len(y)]
            at, up = at + len(x), up + len(y)
            shared = mine > 1
            out.append((b, 0, pack(gaps(x[shared]), mine[shared], gaps(y), theirs)))
    return pd.DataFrame(out, columns=["block", "kind", "blob"])


def _records(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one block: each text with its size, its set's hash and, if it can have a partner, its ordered shared shingles."""
        block = int(pdf["block"].iloc[0])
        ids, known, tags, size, h1, h2, hot = unpack(next(x for k, x in zip(pdf["kind"], pdf["blob"], strict=True) if k == 1))
        hot, took = ungap(hot), [unpack(x) for k, x in zip(pdf["kind"], pdf["blob"], strict=True) if k == 0]
        none = [np.zeros(0, U64)]
        light = np.concatenate([*none, *[ungap(x[0]) for x in took]])
        count = np.concatenate([np.zeros(0, np.uint16), *[x[1] for x in took]])
        hot_keys = np.concatenate([*none, *[ungap(x[2]) for x in took]])
        hot_count = np.concatenate([np.zeros(0, np.uint16), *[x[3] for x in took]])
        by = np.argsort(hot_keys)
        if len(hot):
            place = by[np.searchsorted(hot_keys, hot >> U64(DOC_BITS), sorter=by)]
            light, count = np.concatenate([light, hot]), np.concatenate([count, hot_count[place]])
        doc = (light & U64(BLOCK_DOCS - 1)).astype(np.int64)
        shared = np.bincount(doc, minlength=len(size))
        stays = (shared > 0) & (100 * shared >= percent * size) & (count.max(initial=0) > 1)
        mine = stays[doc] & (count > 1)
        key, doc = light[mine] >> U64(DOC_BITS), doc[mine]
        value = (count[mine].astype(U64) << U64(KEY_BITS) | key).astype(np.int64)
        order = np.lexsort((value, doc))
        value, doc, key = value[order], doc[order], key[order]
        shared = np.bincount(doc, minlength=len(size))
        stays = (shared > 0) & (100 * shared >= percent * size)
        cut = np.concatenate(([0], np.cumsum(shared)))
        parts = np.bincount(doc * BUCKETS + (key & U64(BUCKETS - 1)).astype(np.int64), minlength=len(size) * BUCKETS).reshape(-1, BUCKETS)
        here = range(len(size))
        return pd.DataFrame({
            "uid": (block << DOC_BITS) + np.arange(len(size)),
            "id": [int(i) if ok else None for i, ok in zip(ids, known, strict=True)],
            "tag": tags,
            "n": size,
            "h1": h1.view(np.int64),
            "h2": h2.view(np.int64),
            "vals": [value[cut[i] : cut[i + 1]] if stays[i] else None for i in here],
            "parts": [parts[i] if stays[i] else None for i in here],
        })

    return run


def text_sets(docs: DataFrame, id_col: str, text_col: str, tag_col: str | None, k: int, percent: int) -> DataFrame:
    """Each text with its tag, set size, set hash and shared shingles, in the shared folder."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), (F.col(tag_col) if tag_col else F.lit(0)).cast("long").alias("tag"))
    n_bytes = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = store.parts_for(spark, n_bytes, PART_BYTES)
    sent = own.mapInArrow(tidy(_emitter(k, n_parts)), "part int, block long, kind int, blob binary")
    back = sent.groupBy("part").applyInPandas(tidied(_count_part), "block long, kind int, blob binary")
    out = back.groupBy("block").applyInPandas(tidied(_records(percent)), "uid long, id long, tag long, n long, h1 long, h2 long, vals array<long>, parts array<int>")
    with store.small_batches(spark):
        return store.materialize(out, "sets")


def _verified(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets pass the suffix filter and then reach the threshold, each verified once."""
    x = records.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("vals").alias("va"), F.col("parts").alias("pa"))
    y = records.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("vals").alias("vb"), F.col("parts").alias("pb"))
    both = pairs.join(x, "a").join(y, "b")
    need = F.lit(percent) * (F.col("na") + F.col("nb"))
    most = F.aggregate(F.zip_with("pa", "pb", lambda u, v: F.least(u, v)), F.lit(0), lambda s, v: s + v)
    enough = lambda common: F.lit(100 + percent) * common >= need
    return both.filter(F.when(enough(most), enough(F.size(F.array_intersect("va", "vb")))).otherwise(False)).select("a", "b")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches, by hooking and pointer jumping."""
    both = store.materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{tag}-edges")
    label = store.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), tag)
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = label.join(near, "node", "left").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = label.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = store.materialize(met.join(jump, "to", "left").select("node", F.least("to", "further").alias("label"), F.col("was")), tag)
        moved = new.filter("label <> was").limit(1).count()
        store.forget(label)
        label = new.select("node", "label")
        label._dovetail_path = new._dovetail_path
        if not moved:
            store.forget(both)
            return label


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all sets of y: common shingles by matrix product, rare ones by lists."""
    size = lambda sets: np.array([len(v) for v in sets])
    token, index = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    cut = int(size(x).sum())
    tx, ty = index[:cut], index[cut:]
    dx, dy = np.repeat(np.arange(len(x)), size(x)), np.repeat(np.arange(len(y)), size(y))
    nx, ny = np.bincount(tx, minlength=len(token)), np.bincount(ty, minlength=len(token))
    out = np.zeros(len(x) * len(y), np.int64)
    often = nx * ny >= 2048
    column = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 4096):
        half = []
        for t, d, n in ((tx, dx, len(x)), (ty, dy, len(y))):
            m = np.zeros((n, 4096), np.float32)
            own = often[t] & (column[t] >= lo) & (column[t] < lo + 4096)
            m[d[own], column[t[own]] - lo] = 1
            half.append(m)
        out += (half[0] @ half[1].T).astype(np.int64).reshape(-1)
    by = np.argsort(ty, kind="stable")
    starts = np.cumsum(ny) - ny
    own = np.flatnonzero(~often[tx] & (ny[tx] > 0))
    for lo in range(0, len(own), 1 << 16):
        mine = own[lo : lo + (1 << 16)]
        many = ny[tx[mine]]
        place = np.repeat(starts[tx[mine]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out += np.bincount(np.repeat(dx[mine], many) * len(y) + dy[by[place]], minlength=len(out))
    return out.reshape(len(x), len(y))


def _linker(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of two blocks of texts: links that join what is not joined yet."""
        left = pdf[(pdf["bucket"] == pdf["b1"]) & (pdf["block"] == pdf["i1"])]
        right = pdf[(pdf["bucket"] == pdf["b2"]) & (pdf["block"] == pdf["i2"])]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        common = _intersections(list(left["vals"]), list(right["vals"]))
        n1, n2 = left["n"].to_numpy(), right["n"].to_numpy()
        linked = (common > 0) & ((100 + percent) * common >= percent * (n1[:, None] + n2[None, :]))
        linked &= left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        out = []
        u1, u2, c1, c2 = (v.tolist() for v in (left["uid"], right["uid"], left["comp"], right["comp"]))
        for i, j in zip(*(v.tolist() for v in np.nonzero(linked)), strict=True):
            x, y = find(c1[i]), find(c2[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((u1[i], u2[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _block_links(alive: DataFrame, label: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """Links across components within what still shares an open list, without a row for each pair.

    Texts that open lists connect are a cluster.  A cluster is cut by size into buckets so that only texts of one bucket
    or of neighbours can link (the length filter), and buckets by hash into blocks; each pair of blocks is one group."""
    lists = alive.groupBy("val").agg(F.min("uid").alias("centre"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("val", "centre")
    near = alive.join(lists, "val").filter("uid <> centre").select(F.col("centre").alias("a"), F.col("uid").alias("b")).distinct()
    clusters = components(near, "clusters").select(F.col("node").alias("uid"), F.col("label").alias("cluster"))
    bucket = F.floor(F.log(F.col("n").cast("double")) / float(np.log(101 / percent))).cast("int")
    members = records.join(clusters, "uid").join(label.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "n", "vals", "cluster", F.coalesce("label", "uid").alias("comp"), bucket.alias("bucket"))
    members = store.materialize(members, "members")
    blocks = members.groupBy("cluster", "bucket").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
    own = members.join(blocks, ["cluster", "bucket"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    for name, step in (("above", 1), ("below", -1)):
        own = own.join(blocks.select("cluster", (F.col("bucket") - step).alias("bucket"), F.col("blocks").alias(name)), ["cluster", "bucket"], "left")
    b, i = F.col("bucket"), F.col("block")
    key = lambda b1, i1, b2, i2: F.struct(b1.alias("b1"), i1.alias("i1"), b2.alias("b2"), i2.alias("i2"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    keys = F.concat(
        F.transform(upto(F.col("blocks")), lambda j: key(b, F.least(i, j), b, F.greatest(i, j))),
        F.transform(upto(F.coalesce("above", F.lit(0))), lambda j: key(b, i, b + 1, j)),
        F.transform(upto(F.coalesce("below", F.lit(0))), lambda j: key(b - 1, j, b, i)),
    )
    dealt = own.select("uid", "n", "vals", "cluster", "comp", "bucket", "block", F.explode(keys).alias("key")).select("*", "key.*").drop("key")
    return dealt.groupBy("cluster", "b1", "i1", "b2", "i2").applyInPandas(tidied(_linker(percent)), "a long, b long")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each text: uid, id, n_shingles, component_id (see the module's text for edge cases)."""
    can, classes, alone = _joined(docs, id_col, text_col, None, k, percent)
    first = classes.groupBy("label").agg(F.min("first.id").alias("component_id"))
    of_class = classes.join(first, "label").select("n", "h1", "h2", "component_id")  # classes, not texts, meet by component
    joined = can.select("uid", "id", "n", "h1", "h2").join(of_class, ["n", "h1", "h2"]).select("uid", "id", "n", "component_id")
    return joined.union(alone.select("uid", "id", "n", F.col("id").alias("component_id"))).withColumnRenamed("n", "n_shingles")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag_col: str = "tag", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, tag) of one text of each component: the smallest id, null ones last, then the smallest tag."""
    _, classes, alone = _joined(docs, id_col, text_col, tag_col, k, percent)
    first = classes.groupBy("label").agg(F.min("first").alias("x")).select("x.id", "x.tag")
    return first.union(alone.select("id", "tag"))


def _joined(docs: DataFrame, id_col: str, text_col: str, tag_col: str | None, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts that can have partners; their classes of equal sets with the first text and the component's label; the other texts."""
    every = text_sets(docs, id_col, text_col, tag_col, k, percent)
    can = every.filter(F.col("vals").isNotNull())
    classes = store.materialize(can.groupBy("n", "h1", "h2").agg(F.min("uid").alias("uid"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first")), "classes")
    records = store.materialize(can.join(classes.select("uid"), "uid", "left_semi").select("uid", "n", "vals", "parts"), "records")
    least = F.floor((F.col("n") * percent + 99) / 100).cast("long")
    lone = F.col("n") - F.size("vals")
    spread = records.select("uid", "n", lone.alias("lone"), F.posexplode(F.slice("vals", F.lit(1), (F.col("n") - least + 1 - lone).cast("int"))).alias("pos", "val"))
    alive = store.materialize(spread.select("val", "uid", "n", (F.col("lone") + F.col("pos")).alias("pos"), F.col("uid").alias("comp")), "postings")

    def salts(val):
        """Tasks that a posting list is dealt to: its length bounds (see _count_part) are the value's upper bits."""
        return F.greatest(F.lit(1), F.shiftright(val, KEY_BITS).cast("int") / F.lit(LIST)).cast("int")

    def may_link(n1, p1, n2, p2):
        """Length filter, and the positional filter at a common shingle."""
        total = F.lit(percent) * (n1 + n2)
        by_length = F.lit(100) * F.least(n1, n2) >= F.lit(percent) * F.greatest(n1, n2)
        return by_length & (F.lit(100 + percent) * (F.lit(1) + F.least(p1, p2) + F.least(n1 - p1 - 1, n2 - p2 - 1)) >= total)

    links = None
    for _ in range(STAR_ROUNDS):
        lists = alive.groupBy("val").agg(F.min(F.struct("uid", "n", "pos", "comp")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("val", "c", F.explode(F.sequence(F.lit(0), salts(F.col("val")) - 1)).alias("salt"))
        dealt = alive.withColumn("salt", F.pmod(F.xxhash64("uid"), salts(F.col("val"))).cast("int"))
        open_ = dealt.join(lists, ["val", "salt"]).filter("uid <> c.uid")
        left = store.materialize(open_.select("val", "uid", "n", "pos", "comp", F.col("c.uid").alias("cu"), F.col("c.n").alias("cn"), F.col("c.pos").alias("cp"), F.col("c.comp").alias("cc")), "open")
        pairs = left.filter((F.col("comp") != F.col("cc")) & may_link(F.col("n"), F.col("pos"), F.col("cn"), F.col("cp"))).select(F.col("cu").alias("a"), F.col("uid").alias("b")).distinct()
        found = store.materialize(_verified(pairs, records, percent), "links")
        store.forget(alive)
        links = found if links is None else links.union(found)
        label = components(links)
        alive = store.materialize(left.select("val", "uid", "n", "pos").join(label.withColumnRenamed("node", "uid"), "uid", "left").select("val", "uid", "n", "pos", F.coalesce("label", "uid").alias("comp")), "postings")
        store.forget(left)
        if not alive.limit(1).count():
            break
    else:
        found = store.materialize(_block_links(alive, label, records, percent), "links")
        links = links.union(found)
        label = components(links)
    of_class = classes.join(label.withColumnRenamed("node", "uid"), "uid", "left").select("n", "h1", "h2", "first", F.coalesce("label", "uid").alias("label"))
    return can, of_class, every.filter(F.col("vals").isNull()).select("uid", "id", "tag", "n")


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = ngram_jaccard_join(store.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * i >= 80 * (nx + ny - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON s.doc_id = m.x
"""
