"""A store of documents on Parquet: ingest, search, forget and sync, with commits that don't lose each other's work."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.functions.text import blank, fts_tokens, query_terms, search_prefixes, without_diacritics
from gridlake.operators import kb, sync
from gridlake.streaming.jobs import single_run

#: Times that a change is made anew where another one came between.
ATTEMPTS = 8
#: Fixed value: a line of an ignore file that nobody has edited yet.
UNCONFIGURED = "__UNCONFIGURED__"


class Store:
    """Documents, chunks, postings with block maxima, and an ingest log below a folder.

    Documents are dealt by a hash of uid into buckets; each bucket's tables lie beside it. A change writes the
    buckets that it touches into a folder of its own and is made current by a numbered manifest that names the
    folder of each bucket. A manifest is written aside and renamed to its number, which fails where that is
    taken; then the change looks at what came between: other buckets are left as they are now, and where the
    same ones changed it is made anew from them. So two changes at once both stay, and a lost job, executor or
    driver leaves the last manifest. Postings are sorted by term. buckets is fixed by the first write.
    """

    DOCS = "uid string, source string, origin string, title string, text string, content_hash string, n_chunks int, archived boolean"
    CHUNKS = "uid string, ord int, heading string, text string, n_chars int, n_tokens int"
    POSTINGS = "term string, block long, uid string, ord int, weight double, n_tokens int"
    BLOCKS = "term string, block long, most double, shortest int"
    PREFIXES = "prefix string, n_chunks long"
    SIZES = "n_chunks long, n_tokens long"
    FOUND = "uid string, ord int, heading string, text string, n_chars int, title string, source string, score double, rank int"
    TABLES = {"docs": (DOCS, ["uid"]), "chunks": (CHUNKS, ["uid", "ord"]), "postings": (POSTINGS, ["term", "block", "uid", "ord"]), "blocks": (BLOCKS, ["term", "block"]), "prefixes": (PREFIXES, ["prefix"]), "sizes": (SIZES, [])}
    INDEX = ["chunks", "postings", "blocks", "prefixes", "sizes"]

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.last_search: dict[str, int] = {}

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return at, at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at, fs = self._files()
        folder = at(f"{self.path}/manifests")
        names = [p.getPath().getName() for p in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict | None:
        """number, buckets, and for each table the folder of each bucket that has rows."""
        found = self._numbers()
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{found[-1]:010}.json").first()[0]) if found else None

    def version(self) -> str | None:
        """The folder of the last change."""
        return (self.manifest() or {}).get("version")

    def _table(self, name: str, only: list[int] | None = None, now: dict | None = None) -> DataFrame:
        """A table, or what some buckets hold of it; empty where nothing is stored."""
        at = (now if now is not None else self.manifest() or {}).get(name, {})
        paths = [f"{self.path}/{v}/{name}/bucket={b}" for b, v in sorted(at.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.TABLES[name][0]).parquet(*paths) if paths else self.spark.createDataFrame([], self.TABLES[name][0])

    def docs(self) -> DataFrame | None:
        now = self.manifest()
        return self._table("docs", now=now) if now else None

    def chunks(self) -> DataFrame | None:
        now = self.manifest()
        return self._table("chunks", now=now).drop("n_tokens") if now else None

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest took its number; complete or not there at all."""
        at, fs = self._files()
        aside = at(f"{self.path}/manifests/next-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True), "utf-8"))
        out.close()
        sc = self.spark.sparkContext
        none = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:  # never over another one
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(at(f"{self.path}/manifests/{manifest['number']:010}.json")), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(aside, False)
            return False

    def _commit(self, base: dict, version: str, touched: dict[str, list[int]]) -> bool:
        """Name version as the folder of the touched buckets of each table; False where another change has touched one since base."""
        at, fs = self._files()
        there = {name: {str(b): version for b in own if fs.exists(at(f"{self.path}/{version}/{name}/bucket={b}"))} for name, own in touched.items()}
        while True:
            now = self.manifest() or {"number": 0, "buckets": base["buckets"]}
            if now["buckets"] != base["buckets"] or any(now.get(n, {}).get(str(b)) != base.get(n, {}).get(str(b)) for n, own in touched.items() for b in own):
                return False
            new = now | {"number": now["number"] + 1, "version": version}
            for name, own in touched.items():
                new[name] = {b: v for b, v in now.get(name, {}).items() if int(b) not in own} | there[name]
            if self._publish(new):
                return True

    def _put(self, version: str, name: str, df: DataFrame) -> DataFrame:
        """Write buckets of a table, dealt by ranges (no bucket is one task), sorted within files; read back with their bucket."""
        kind, order = self.TABLES[name]
        out = f"{self.path}/{version}/{name}"
        columns = [c.split()[0] for c in kind.split(", ")]
        df.select(*columns, "bucket").repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(out)
        return self.spark.read.schema(f"{kind}, bucket int").parquet(out)

    def vacuum(self) -> list[str]:
        """Delete the folders that no bucket names any more and older manifests; for times without readers of an older state and without changes."""
        at, fs = self._files()
        now = self.manifest() or {}
        used = {v for name in self.TABLES for v in now.get(name, {}).values()}
        old = [p.getPath().getName() for p in fs.listStatus(at(self.path)) if p.getPath().getName().startswith("v-")]
        gone = sorted(v for v in old if v not in used)
        for v in gone:
            fs.delete(at(f"{self.path}/{v}"), True)
        for p in fs.listStatus(at(f"{self.path}/manifests")):
            if p.getPath().getName() != f"{now.get('number', 0):010}.json":
                fs.delete(p.getPath(), False)
        return gone

    def _changed(self, make) -> DataFrame | None:
        """make(base manifest, version) until what it wrote is committed; it returns (touched buckets by table, result)."""
        for _ in range(ATTEMPTS):
            base, version = self.manifest() or {"buckets": self.buckets}, f"v-{uuid.uuid4().hex}"
            touched, result = make(base, version)
            if not any(touched.values()) and "number" in base or self._commit(base, version, touched):
                return result
        raise RuntimeError(f"{self.path}: other changes came between {ATTEMPTS} times")

    def _bucket(self, base: dict) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(base["buckets"])).cast("int")

    def _upserted(self, base: dict, version: str, done: DataFrame, gone: DataFrame | None, most_chunks: int) -> tuple[dict[str, list[int]], DataFrame]:
        """Write what new and updated documents (of done) and vanished ones (uids in gone) change; each document's chunks are cut once."""
        bucket = self._bucket(base)
        buckets_of = lambda df: [r[0] for r in df.select(bucket).distinct().collect()]  # noqa: E731  as many numbers as buckets at most
        fresh = done.where("ingest IN ('new', 'updated')")
        cut = kb.chunks(fresh.select("uid", "text"), "uid")
        inner = buckets_of(fresh)
        every = sorted({*inner, *(buckets_of(gone) if gone is not None else [])})
        old = lambda name: self._table(name, inner, base)
        if inner:
            uids = fresh.select("uid")
            new = cut.where(F.col("ord") < most_chunks).withColumn("n_tokens", kb.n_tokens("text", "heading", fts_tokens))
            chunks = self._put(version, "chunks", old("chunks").join(uids, "uid", "left_anti").unionByName(new).withColumn("bucket", bucket))
            block = F.shiftleft(bucket.cast("long"), 40) + kb.block_of(F.col("n_tokens"), F.col("uid"), F.col("ord"))
            have = chunks.drop("bucket").join(uids, "uid", "left_semi")
            index = kb.postings(have, ["uid", "ord", "n_tokens"], "text", "heading", fts_tokens).withColumn("block", block)
            index = self._put(version, "postings", old("postings").join(uids, "uid", "left_anti").unionByName(index).withColumn("bucket", bucket))
            self._put(version, "blocks", kb.block_maxima(index, ["bucket"]))
            self._put(version, "prefixes", kb.prefix_counts(index, ["uid", "ord"], ["bucket"]))
            self._put(version, "sizes", chunks.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")))
            counts = have.groupBy("uid").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
            fresh = fresh.join(counts, "uid", "left").na.fill(0, ["n_chunks"])
        if every:
            docs = kb.merged(fresh.drop("error"), self._table("docs", every, base)) if inner else self._table("docs", every, base)
            if gone is not None:
                hit = gone.select("uid", F.lit(True).alias("__gone")).distinct()
                docs = docs.join(hit, "uid", "left").withColumn("archived", F.col("archived") | F.coalesce("__gone", F.lit(False)))
            self._put(version, "docs", docs.withColumn("bucket", bucket))
        return {"docs": every} | dict.fromkeys(self.INDEX, inner), cut

    def _logged(self, base: dict, incoming: DataFrame, by_content: bool) -> DataFrame:
        """The status of each incoming document, written: later steps and retries read the same."""
        if "error" not in incoming.columns:
            incoming = incoming.withColumn("error", F.lit(None).cast("string"))
        at = f"{self.path}/log/{uuid.uuid4().hex}"
        told = kb.classify_ingest(kb.identified(incoming.where("error IS NULL"), by_content), self._table("docs", now=base))
        failed = incoming.where("error IS NOT NULL").withColumn("ingest", F.lit("error"))
        told.unionByName(failed, allowMissingColumns=True).write.parquet(at)
        return self.spark.read.parquet(at)

    def _discard(self, df: DataFrame) -> None:
        at, fs = self._files()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs.delete(at(folder), True)

    def ingest(self, incoming: DataFrame, by_content: bool = False, most_chunks: int = kb.MOST_CHUNKS) -> DataFrame:
        """Upsert source, origin, text, title, seq; the status of each as logged. Only new and updated ones are cut.

        A row with an error (an optional column: why its text couldn't be read) is logged as such and changes
        nothing; the others go on. The first most_chunks chunks of a document are stored; beside the status
        stand n_found, the chunks that its text has, and n_stored, both null where it is unchanged or failed.
        """
        last: list[DataFrame] = []

        def make(base: dict, version: str):
            for before in last:
                self._discard(before)  # its change wasn't made
            last[:] = [self._logged(base, incoming, by_content)]
            touched, cut = self._upserted(base, version, last[0], None, most_chunks)
            return touched, (last[0], cut)

        done, cut = self._changed(make)
        every = cut.groupBy("uid").agg(F.count(F.lit(1)).cast("int").alias("__n"))
        n_found = F.when(F.col("ingest").isin("new", "updated"), F.coalesce("__n", F.lit(0)))
        return done.join(every, "uid", "left").select("seq", "uid", "source", "origin", "ingest", n_found.alias("n_found"), F.least(n_found, F.lit(most_chunks)).alias("n_stored"), "error")

    def log(self) -> DataFrame:
        """Every document of every ingest: seq, source, origin, ingest (new, updated, unchanged or error), error."""
        at, fs = self._files()
        kind = "seq long, source string, origin string, ingest string, error string"
        if not fs.exists(at(f"{self.path}/log")):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/log").select(F.col("seq").cast("long"), "source", "origin", "ingest", "error")

    def _archive(self, gone_of) -> None:
        """Mark the documents whose uids gone_of(manifest) gives; only their buckets are written, chunks and postings stay."""
        empty = self.spark.createDataFrame([], "uid string, text string, ingest string")
        self._changed(lambda base, version: self._upserted(base, version, empty, gone_of(base), 0))

    def forget(self, key: str) -> tuple[str, list[tuple[str, str]]]:
        """(ok, not_found or ambiguous, candidates): by uid, else by the one active title that contains key; never many."""
        docs, key = self.docs(), key.strip()
        if docs is None or not key:
            return "not_found", []
        active = docs.where("NOT archived")
        hits = active.where(F.col("uid") == key).select("uid", "title").limit(1).collect()
        hits = hits or active.where(F.contains(F.lower("title"), F.lit(key.lower()))).select("uid", "title").orderBy("uid").limit(11).collect()
        if len(hits) != 1:
            return ("ambiguous", [tuple(h) for h in hits[:10]]) if hits else ("not_found", [])
        self._archive(lambda base: self.spark.createDataFrame([(hits[0].uid,)], "uid string"))
        return "ok", [tuple(hits[0])]

    def search(self, question: str, most: int = 30, terms: list[str] | None = None) -> DataFrame:
        """Ranked chunks of active documents: uid, ord, heading, text, n_chars, title, source, score, rank.

        Statistics are kept with the index: chunks, their tokens, and chunks by prefix, archived ones too. Blocks
        whose bound can't reach the last place aren't read (last_search has the counts); then the texts of what
        is found are. terms replaces the words of the question. Words and texts are compared without diacritics,
        and a word is split at any apostrophe, as stored texts are. An empty store or question ends at once.
        """
        self.last_search = {"blocks": 0, "read": 0}
        now = self.manifest()
        words = self.spark.range(1).select(_prefixes(question, terms)).first()[0] if now and now.get("postings") else []
        if not words:
            return self.spark.createDataFrame([], self.FOUND)
        index, ids = self._table("postings", now=now), ["uid", "ord"]
        size = self._table("sizes", now=now).agg(F.sum("n_chunks").alias("n"), F.sum("n_tokens").alias("t")).first()
        counted = self._table("prefixes", now=now).where(F.col("prefix").isin(words)).groupBy("prefix").agg(F.sum("n_chunks").alias("n")).collect()
        hits = {r.prefix: r.n for r in counted}
        for long in (w for w in words if len(w) > kb.PREFIX_LETTERS[1]):
            hits[long] = index.where(F.startswith("term", F.lit(long))).select(*ids).distinct().count()
        tagged = self._table("docs", now=now).where("NOT archived").select("uid", F.when(F.col("source") == "chat", 0.6).otherwise(1.0).alias("__w"))
        weigh = lambda found: found.join(tagged, "uid").select(*ids, (F.col("score") * F.col("__w")).alias("score"))
        best, self.last_search = kb.top_by_blocks(index, self._table("blocks", now=now), words, hits, size.n, size.t / size.n, ids, most, weigh)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("score", *ids)))
        titles = self._table("docs", now=now).select("uid", "source", "title")
        found = self._table("chunks", now=now).drop("n_tokens").join(F.broadcast(ranked), ids)  # most rows
        return found.join(F.broadcast(titles.join(F.broadcast(ranked.select("uid").distinct()), "uid", "left_semi")), "uid").select(*ids, "heading", "text", "n_chars", "title", "source", "score", "rank")

    def sync(self, tree: DataFrame, patterns: list[str] | None, today: Column) -> tuple[str, dict | None]:
        """Make the store follow a tree (origin, text, error if some can't be read): (state, counts).

        state: ok, no_ignore_file, unconfigured (the ignore file still has its first line), or busy while another
        run holds the lock. Vanished origins, ignored and aged ones are archived in the same commit. counts: files,
        ingested, unchanged, errors, aged, archived, and skipped, the first folders of ignored files.
        """
        if patterns is None:
            return "no_ignore_file", None
        if any(p.strip() == UNCONFIGURED for p in patterns):
            return "unconfigured", None
        with single_run(self.spark, f"{self.path}/sync.lock") as held:
            return ("ok", self._synced(tree, patterns, today)) if held else ("busy", None)

    def _synced(self, tree: DataFrame, patterns: list[str], today: Column) -> dict:
        marked = tree.withColumn("__ignored", sync.ignored(F.col("origin"), patterns)).withColumn("source", sync.source_of(F.col("origin")))
        aged = ~F.col("__ignored") & (F.col("source") == "chat") & ~sync.young(F.col("origin"), today)
        marked = marked.withColumn("__aged", aged)
        error = F.col("error") if "error" in tree.columns else F.lit(None).cast("string")
        seen = marked.where("NOT __ignored AND NOT __aged").withColumn("title", F.col("origin")).withColumn("seq", F.lit(0))
        seen = seen.withColumn("error", F.coalesce(error, F.when(blank(F.col("text")), "no text"))).drop("__ignored", "__aged")
        last: list[DataFrame] = []

        def make(base: dict, version: str):
            for before in last:
                self._discard(before)
            done = self._logged(base, seen, True)
            last[:] = [done]
            live = self._table("docs", now=base).where("NOT archived AND source IN ('vault', 'chat')").select("uid", "source", "origin")
            gone = live.join(seen.select("source", "origin"), ["source", "origin"], "left_anti")
            touched, _ = self._upserted(base, version, done, gone, kb.MOST_CHUNKS)
            return touched, (done, gone.count())

        done, archived = self._changed(make)
        by = {r.ingest: r.n for r in done.groupBy("ingest").agg(F.count(F.lit(1)).alias("n")).collect()}
        files = marked.agg(F.count(F.lit(1)).alias("files"), F.count_if("__aged").alias("aged"), F.collect_set(F.when(F.col("__ignored"), F.split_part("origin", F.lit("/"), F.lit(1)))).alias("skipped")).first()
        return {"files": files.files, "ingested": by.get("new", 0) + by.get("updated", 0), "unchanged": by.get("unchanged", 0), "errors": by.get("error", 0), "aged": files.aged, "archived": archived, "skipped": sorted(files.skipped)}


def _prefixes(question: str, terms: list[str] | None = None) -> Column:
    words = F.lit(" ".join(terms)) if terms else F.array_join(query_terms(without_diacritics(F.lit(question))), " ")
    return search_prefixes(without_diacritics(words))
