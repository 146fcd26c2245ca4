"""A search index that is kept up to date: immutable segments, tombstones, and a queue of what has changed.

A segment holds the terms, names and forward rows (a document's distinct terms) of the documents of one batch, the batch's
ids (which hide these documents in all segments before), and the signed change of document frequencies. A manifest names
the segments and has the corpus' number and total length of documents, so a batch appears whole or not at all, together
with the acknowledgement of its queue entries. Readers see live rows, those of the last segment that touched a document;
``search`` and all else that takes an Index works on them. Weights are those of the corpus at the time of the batch;
reweighting brings all documents to the present frequencies, ``compact`` makes one segment of all.

``drain`` is one turn of maintenance: at most ``limit`` queued documents, the oldest first; if there are none, and only in
the nightly window, a batch of the weekly reweighting, in order of id. After a failure nothing is tried for RETRY seconds.

Defined results: a queued id without a document is deleted; an id that was never indexed is added; an id that is queued
again while its batch runs stays queued; null ids are ignored; repeated ids of a batch count once; an empty queue is no
batch.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.manifests import Manifests
from .search import BUCKETS, Index, document_keys, listed, named, packed, unpacked, weighted, write_terms

# fixed values: the batch, the week between two reweightings, their hours (UTC+8), the pause after a failure
BATCH = 10
REWEIGHT_EVERY = 7 * 86_400
REWEIGHT_HOURS = range(3, 5)
WINDOW_ZONE = timezone(timedelta(hours=8))
RETRY = 30

BROADCAST_IDS = 1_000_000  # 16 MB of ids and numbers
QUEUE = "doc_id long, queued_at long"


@dataclass(frozen=True)
class Segmented(Index):
    """The live rows of all segments, as an Index."""

    segments: tuple[dict, ...] = ()

    def _all(self, name: str) -> DataFrame:
        read = lambda s: self.spark.read.parquet(f"{self.path}/segments/{s['id']}/{name}").withColumn("_seq", F.lit(s["seq"]))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(read, self.segments))

    def _live(self, rows: DataFrame) -> DataFrame:
        later = self.segments[1:]
        if not later:
            return rows.drop("_seq")
        ids = [self.spark.read.parquet(f"{self.path}/segments/{s['id']}/touched").select("doc_id", F.lit(s["seq"]).alias("_last")) for s in later]
        last = reduce(DataFrame.unionByName, ids).groupBy("doc_id").agg(F.max("_last").alias("_last"))
        if sum(s["touched"] for s in later) <= BROADCAST_IDS:
            last = F.broadcast(last)
        return rows.join(last, "doc_id", "left").where("_last is null or _last <= _seq").drop("_last", "_seq")

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            rows = self._all(name)
            if name == "vocabulary":
                rows = rows.groupBy("term").agg(F.min("kind").alias("kind"), F.sum("df").alias("df")).where("df > 0")
            self.tables[name] = rows if name == "vocabulary" else self._live(rows)
        return self.tables[name]


class Maintained:
    """The index below ``root`` and its maintenance."""

    def __init__(self, spark: SparkSession, root: str, charmap: dict[str, str] | None = None):
        self.spark, self.root, self.charmap = spark, root.rstrip("/"), charmap
        self.manifests = Manifests(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, docs: DataFrame, buckets: int = BUCKETS, charmap: dict[str, str] | None = None) -> Maintained:
        """Indexes docs as the first segment."""
        m = cls(spark, root, charmap)
        state = {"buckets": buckets, "pinyin": "pinyin" in docs.columns, "segments": [], "acks": [], "n_docs": 0, "total_dl": 0, "reweight_at": None, "reweight_after": None, "retry_after": 0, "last_error": "", "last_success": None}
        m._batch(0, state, docs, docs.select("doc_id"), None, {})
        return m

    def _index(self, state: dict) -> Segmented:
        n = state["n_docs"]
        return Segmented(self.spark, self.root, n, state["total_dl"] / n if n else 1.0, state["buckets"], state["pinyin"], self.charmap, segments=tuple(state["segments"]))

    def open(self) -> Segmented:
        """The index as it is now; later batches do not change what it reads."""
        return self._index(self.manifests.latest()[1])

    def enqueue(self, ids: DataFrame, now: int) -> None:
        """Queues ids (doc_id) whose documents changed, appeared or are gone."""
        rows = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(now).cast("long").alias("queued_at")).where("doc_id is not null").distinct()
        rows.write.mode("append").parquet(f"{self.root}/queue")

    def enqueue_unindexed(self, docs: DataFrame, now: int) -> None:
        """Queues all documents that no segment has: what a crash between a document's write and its queue entry left."""
        self.enqueue(docs.select("doc_id").join(self.open().table("forward").select("doc_id"), "doc_id", "left_anti"), now)

    def _queue(self) -> DataFrame:
        try:
            return self.spark.read.schema(QUEUE).parquet(f"{self.root}/queue")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], QUEUE)

    def pending(self, state: dict | None = None) -> DataFrame:
        """doc_id, queued_at (its last) of queue entries that no batch has taken since."""
        state = state or self.manifests.latest()[1]
        queued = self._queue().groupBy("doc_id").agg(F.max("queued_at").alias("queued_at"))
        if state["acks"]:
            acks = self.spark.read.parquet(*[f"{self.root}/{a}" for a in state["acks"]]).groupBy("doc_id").agg(F.max("as_of").alias("as_of"))
            queued = queued.join(acks, "doc_id", "left").where("as_of is null or as_of < queued_at").drop("as_of")
        return queued

    def _batch(self, number: int, state: dict, docs: DataFrame, ids: DataFrame, acks: DataFrame | None, more: dict) -> None:
        """Writes the segment of ``ids`` (doc_id): their documents in docs, if any, and commits it with ``more`` of the state."""
        spark, sid = self.spark, uuid.uuid4().hex
        at = f"{self.root}/segments/{sid}"
        ids.where("doc_id is not null").distinct().write.parquet(f"{at}/touched")
        ids = spark.read.parquet(f"{at}/touched")
        seq, first = (state["segments"][-1]["seq"] + 1 if state["segments"] else 1), not state["segments"]
        docs = docs.where("doc_id is not null") if first else docs.join(ids, "doc_id", "left_semi")
        # a document's terms are counted in its row, which has all that the segment keeps of it
        counted = document_keys(docs, self.charmap, packs=packed(docs, 1, charmap=self.charmap))
        counted.select("doc_id", "doc", "names", F.get("packs", 0).alias("p")).write.parquet(f"{at}/postings")
        keys = spark.read.parquet(f"{at}/postings")
        p = keys.where("p is not null").select("doc_id", "doc", "p.*").drop("bucket", "part", "named")
        forward = p.select("doc_id", "dl", listed(p).alias("terms"))
        p = unpacked(p)
        p = p.withColumn("doc", F.when(named(p), F.col("doc")))
        forward.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{at}/forward")
        forward = spark.read.parquet(f"{at}/forward")
        signed = lambda rows, sign: rows.select(F.explode("terms").alias("t"), F.lit(sign).cast("long").alias("df")).select("t.term", "t.kind", "df")
        change, index = signed(forward, 1), self._index(state)
        size = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        n, dl = size["n"], size["dl"]
        if not first:
            gone = index.table("forward").join(ids, "doc_id", "left_semi")
            change = change.unionByName(signed(gone, -1))
            size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
            n, dl = n - size["n"], dl - size["dl"]
        vocabulary = change.groupBy("term").agg(F.min("kind").alias("kind"), F.sum("df").alias("df")).where("df <> 0")
        vocabulary.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/vocabulary")
        names = keys.select("doc_id", "doc.key", "doc.boost", F.explode("names").alias("x")).select("x.name", "x.kind", "doc_id", "key", "boost")
        names.repartitionByRange("name", "doc_id").sortWithinPartitions("name").write.parquet(f"{at}/names")
        new = {**state, **more, "n_docs": state["n_docs"] + n, "total_dl": state["total_dl"] + dl, "segments": [*state["segments"], {"id": sid, "seq": seq, "touched": ids.count()}]}
        if acks is not None:
            acks.write.parquet(f"{at}/acks")
            new["acks"] = [*state["acks"], f"segments/{sid}/acks"]
        after = self._index(new)
        df = after.table("vocabulary").select("term", "df")
        if not first:  # only what the batch's terms need of the vocabulary
            df = df.join(p.select("term").distinct(), "term", "left_semi")
        write_terms(weighted(p.join(df, "term"), max(1, after.n_docs), after.avgdl or 1.0), f"{at}/terms", state["buckets"])
        self.manifests.put(number + 1, new)
        self.manifests.delete(f"segments/{sid}/postings")

    def _reweighted(self, state: dict, now: int) -> tuple[dict, str | None]:
        """(changes of the state, the id after which this turn's reweighting goes on; None for no turn)."""
        if state["reweight_at"] is None:  # a new index has its weights
            return {"reweight_at": now + REWEIGHT_EVERY}, None
        if datetime.fromtimestamp(now, WINDOW_ZONE).hour not in REWEIGHT_HOURS:
            return {}, None
        if state["reweight_after"] is None and state["reweight_at"] <= now:
            return {"reweight_at": now + REWEIGHT_EVERY, "reweight_after": -(2**63)}, -(2**63)
        return {}, state["reweight_after"]

    def drain(self, docs: DataFrame, now: int, limit: int = BATCH) -> int:
        """One turn; gives the number of documents that were indexed, deleted or reweighted. docs: the documents as they
        are now."""
        number, state = self.manifests.latest()
        if state["retry_after"] > now:
            return 0
        taken = self.pending(state).orderBy("queued_at", "doc_id").limit(limit)
        batch = [(r["doc_id"], r["queued_at"]) for r in taken.collect()]  # at most ``limit``
        more: dict = {}
        if not batch:
            more, after = self._reweighted(state, now)
            if after is not None:
                ids = self._index(state).table("forward").where(F.col("doc_id") > after).orderBy("doc_id").limit(limit).select("doc_id")
                batch = [(r["doc_id"], None) for r in ids.collect()]
                more["reweight_after"] = batch[-1][0] if batch else None
            if not batch:
                if more:
                    self.manifests.put(number + 1, state | more)
                return 0
        rows = self.spark.createDataFrame(batch, "doc_id long, as_of long")
        try:
            self._batch(number, state, docs, rows.select("doc_id"), rows if batch[0][1] is not None else None, more | {"last_success": now, "last_error": ""})
        except Exception as e:
            self.manifests.put(number + 1, state | {"retry_after": now + RETRY, "last_error": type(e).__name__})
            raise
        return len(batch)

    def catch_up(self, docs: DataFrame, now: int) -> None:
        """All that is queued, however much, as one batch; its ids stay in tables. For the first load and after a stop."""
        number, state = self.manifests.latest()
        rows = written(self.pending(state).select("doc_id", F.col("queued_at").alias("as_of")), "batch")
        if not rows.isEmpty():
            self._batch(number, state, docs, rows.select("doc_id"), rows, {"last_success": now, "last_error": ""})

    def compact(self) -> None:
        """One segment of all live rows, with their weights; the queue's acknowledgements in one folder."""
        number, state = self.manifests.latest()
        index, sid = self._index(state), uuid.uuid4().hex
        at = f"{self.root}/segments/{sid}"
        write_terms(index.table("terms").drop("bucket"), f"{at}/terms", state["buckets"])
        index.table("forward").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{at}/forward")
        index.table("vocabulary").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/vocabulary")
        index.table("names").repartitionByRange("name", "doc_id").sortWithinPartitions("name").write.parquet(f"{at}/names")
        acks = []
        if state["acks"]:
            old = self.spark.read.parquet(*[f"{self.root}/{a}" for a in state["acks"]])
            old.groupBy("doc_id").agg(F.max("as_of").alias("as_of")).write.parquet(f"{at}/acks")
            acks = [f"segments/{sid}/acks"]
        self.manifests.put(number + 1, state | {"acks": acks, "segments": [{"id": sid, "seq": state["segments"][-1]["seq"], "touched": 0}]})

    def vacuum(self) -> None:
        """Forgets older states and the segments that only they name."""
        number, state = self.manifests.latest()
        keep = {s["id"] for s in state["segments"]}
        old = [n for n in self.manifests.numbers() if n < number]
        gone = {s["id"] for n in old for s in self.manifests.load(n)["segments"]} - keep
        for n in old:
            self.manifests.forget(n)
        for sid in gone:
            self.manifests.delete(f"segments/{sid}")
