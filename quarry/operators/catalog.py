"""The document store: segments of Parquet under a manifest that is swapped whole.

An ingest writes a new segment of documents, chunks, postings, lengths and vectors; a
delete or a replacement writes tombstones (document, segments before n). Nothing written
is changed, so a failed write leaves the last manifest as it was, readers keep the version
they opened, and going back is a swap. `compact` folds segments into one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import EngineConfig, check_choice, require
from quarry.functions import text as X
from quarry.functions.vectors import with_vectors
from quarry.operators import index as I
from quarry.sources.files import read_files
from quarry.sources.web import read_pages
from quarry.sources.work import written

FORMAT = 1
#: An ingest that leaves more segments folds them: a scan opens each, and streams make one per micro-batch.
MOST_SEGMENTS = 64
TABLES = ("documents", "chunks", "postings", "lengths", "vectors")
SOURCE_TYPES, STATUSES = ("upload", "web"), ("pending", "processing", "indexed", "failed")
DOCUMENT = (
    "document_id string, title string, original_filename string, source_type string, source_url string, mime_type string, file_size_bytes long, sha256 string, "
    "status string, chunk_count long, keyword_indexed boolean, vector_indexed boolean, extra_metadata map<string,string>, error_message string, created_at timestamp, updated_at timestamp, indexed_at timestamp"
)
CHUNK = "chunk_id string, document_id string, position int, text string, token_count int, page_start int, page_end int, section_title string, char_start int, char_end int, extra_metadata map<string,string>"
SCHEMAS = {
    "documents": DOCUMENT,
    "chunks": CHUNK,
    "postings": "term string, chunk_id string, document_id string, tf int, positions array<int>",
    "lengths": "chunk_id string, document_id string, length int",
    "vectors": "chunk_id string, document_id string, position int, page_start int, page_end int, section_title string, embedding array<double>",
}
MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "html": "text/html"}


@dataclass
class Store:
    """A catalog below a folder that all executors reach."""

    spark: SparkSession
    root: str
    config: EngineConfig = EngineConfig()

    # -- manifest ---------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, where = self._fs(), self._path("manifests")
        if not fs.exists(where):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json") and f.getPath().getName()[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty store has no segments."""
        found = self.versions()
        if not found:
            return {"format": FORMAT, "version": 0, "segments": [], "tombstones": []}
        version = found[-1] if version is None else version
        got = json.loads(self.spark.sparkContext.wholeTextFiles(self._path("manifests", f"{version:09d}.json").toString()).first()[1])
        require(got.get("format") == FORMAT, f"unknown store format {got.get('format')}")
        require(isinstance(got.get("segments"), list) and isinstance(got.get("tombstones"), list), "the manifest is damaged")
        return got

    def _commit(self, was: dict, segments: list[dict], tombstones: list[dict], vectors: dict | None = None) -> dict:
        """The next manifest, under a temporary name first; two writers cannot both succeed."""
        now = {"format": FORMAT, "version": was["version"] + 1, "segments": segments, "tombstones": tombstones, "vectors": vectors}
        fs = self._fs()
        temporary, final = self._path("manifests", f".{uuid.uuid4().hex}.tmp"), self._path("manifests", f"{now['version']:09d}.json")
        self._put(temporary, now)
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError("another writer was first; try again")
        return now

    def roll_back(self) -> dict:
        """The version before becomes the newest again."""
        found = self.versions()
        require(len(found) > 0, "there is nothing to go back to")
        was = self.manifest(found[-2]) if len(found) > 1 else {"segments": [], "tombstones": []}
        return self._commit(self.manifest(), was["segments"], was["tombstones"], was.get("vectors"))

    # -- reading ----------------------------------------------------------------------

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The live rows of a table: all segments without what tombstones took.

        Vectors that were made anew stand for those of all segments before.
        """
        m = manifest or self.manifest()
        rows = self.spark.createDataFrame([], SCHEMAS[name]).withColumn("segment", F.lit(0))
        paths = {s["number"]: f"{s['path']}/{name}" for s in m["segments"]}
        if name == "vectors" and (anew := m.get("vectors")):
            paths = {n: p for n, p in paths.items() if n >= anew["before"]} | {anew["before"] - 1: anew["path"]}
        for number, path in sorted(paths.items()):
            rows = rows.unionByName(self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{path}").withColumn("segment", F.lit(number)))
        if not m["tombstones"]:
            return rows.drop("segment")
        dead = self.spark.read.schema("document_id string, before int").parquet(*[f"{self.root}/{t['path']}" for t in m["tombstones"]]).groupBy("document_id").agg(F.max("before").alias("before"))
        gone = (rows["document_id"] == dead["document_id"]) & (rows["segment"] < dead["before"])
        return rows.join(dead, gone, "left_anti").drop("segment")

    def index(self) -> I.Index:
        """The lexical index over live rows. Its derived tables are made once for what a manifest refers to, then read."""
        m = self.manifest()
        postings, lengths = self.table("postings", m), self.table("lengths", m)
        if (path := self._derived(m)) is None:
            path = f"index/{uuid.uuid4().hex}"

            def keep(rows: DataFrame, name: str, sort: tuple[str, ...] = ()) -> DataFrame:
                rows = shaped(rows, I.DERIVED[name])
                (rows.sortWithinPartitions(*sort) if sort else rows).write.parquet(f"{self.root}/{path}/{name}")
                return self._read(path, name)

            try:
                I.derive(postings, lengths, self.config.stem, self.config.champion_size, keep)
            except Exception:
                self._fs().delete(self._path(path), True)  # nothing refers to it yet
                raise
            made, path = path, self._point(m, path)
            if path != made:
                self._fs().delete(self._path(made), True)
        return I.Index(postings, lengths, *(self._read(path, name) for name in I.DERIVED), stem=self.config.stem, champion_size=self.config.champion_size)

    def _read(self, path: str, name: str) -> DataFrame:
        return self.spark.read.schema(I.DERIVED[name]).parquet(f"{self.root}/{path}/{name}")

    def _pointer(self, m: dict):
        """The file that says where the derived tables of these segments and tombstones are, under these settings."""
        what = [I.DERIVED, [s["path"] for s in m["segments"]], [t["path"] for t in m["tombstones"]], self.config.stem, self.config.champion_size]
        return self._path("index", hashlib.sha256(json.dumps(what).encode()).hexdigest() + ".json")

    def _derived(self, m: dict) -> str | None:
        where = self._pointer(m)
        return json.loads(self.spark.sparkContext.wholeTextFiles(where.toString()).first()[1])["path"] if self._fs().exists(where) else None

    def _point(self, m: dict, path: str) -> str:
        """Refers to tables that are complete and returns their path; where another writer was first, its tables stand."""
        temporary, final = self._path("index", f".{uuid.uuid4().hex}.tmp"), self._pointer(m)
        self._put(temporary, {"path": path})
        if self._fs().exists(final) or not self._fs().rename(temporary, final):
            self._fs().delete(temporary, False)
            return self._derived(m)
        return path

    def _put(self, path, value: dict) -> None:
        out = self._fs().create(path, True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
        finally:
            out.close()

    def get(self, document_id: str) -> DataFrame:
        return self.table("documents").filter(F.col("document_id") == document_id)

    def listing(self, limit: int = 20, offset: int = 0, source_type: str | None = None, status: str | None = None) -> tuple[DataFrame, int]:
        """(a page, newest first; how many there are with these filters)."""
        require(1 <= limit <= 100 and offset >= 0, "limit must be in 1..100, offset at least 0")
        rows = filtered(self.table("documents"), source_type, status)
        return page_of(rows, limit, offset), rows.count()

    def every_page(self, size: int = 100):
        """Pages of the listing until it ends."""
        offset, total = 0, None
        while total is None or offset < total:
            page, total = self.listing(size, offset)
            yield page
            offset += size

    def stats(self) -> dict:
        m = self.manifest()
        lexical = I.collection_stats(self.table("postings", m), self.table("lengths", m)).first().asDict()
        return {"document_count": lexical["n_documents"], "chunk_count": lexical["n_chunks"], "vocabulary_size": lexical["n_terms"], "posting_count": lexical["n_postings"], "vector_count": self.table("vectors", m).count()}

    # -- writing ----------------------------------------------------------------------

    def add(self, documents: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> dict:
        """Adds or replaces documents as a whole: a new segment, and tombstones for what it replaces."""
        got = chunks.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_distinct("document_id").alias("documents")).first()
        require(got["n"] > 0, "a document needs at least one chunk")
        require(got["n"] == got["ids"], "chunk ids must be unique")
        was = self.manifest()
        number = max((s["number"] for s in was["segments"]), default=0) + 1
        path = f"segments/{number:09d}-{uuid.uuid4().hex[:8]}"
        counts = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
        now = F.current_timestamp()
        ready = documents.drop("chunk_count").join(counts, "document_id").withColumns({"status": F.lit("indexed"), "chunk_count": F.col("n"), "keyword_indexed": F.lit(True), "vector_indexed": F.lit(True), "created_at": now, "updated_at": now, "indexed_at": now, "error_message": F.lit(None).cast("string")})
        if vectors is None:
            vectors = with_vectors(chunks, "text", self.config.embedder, self.config.embedding_dims)
        tables = {"documents": ready, "chunks": chunks, "postings": I.postings_of(chunks, self.config.stem), "lengths": I.lengths_of(chunks), "vectors": vectors}
        try:
            for name, df in tables.items():
                shaped(df, SCHEMAS[name]).sortWithinPartitions("term" if name == "postings" else "document_id").write.parquet(f"{self.root}/{path}/{name}")
            stones = self._tombstones(self.spark.read.parquet(f"{self.root}/{path}/documents").select("document_id"), number, was)
        except Exception:
            self._fs().delete(self._path(path), True)  # nothing refers to it yet
            raise
        now = self._commit(was, [*was["segments"], {"number": number, "path": path}], [*was["tombstones"], *stones], was.get("vectors"))
        return self.compact() if len(now["segments"]) > MOST_SEGMENTS else now

    def _tombstones(self, ids: DataFrame, before: int, was: dict) -> list[dict]:
        if not was["segments"]:
            return []
        path = f"tombstones/{uuid.uuid4().hex}"
        ids.distinct().select("document_id", F.lit(before).alias("before")).coalesce(1).write.parquet(f"{self.root}/{path}")
        return [{"path": path}]

    def delete(self, document_id: str) -> bool:
        """Takes a document, its chunks, postings and vectors out; False if it is not there."""
        if self.get(document_id).isEmpty():
            return False
        was = self.manifest()
        before = max(s["number"] for s in was["segments"]) + 1
        stones = self._tombstones(self.spark.createDataFrame([(document_id,)], "document_id string"), before, was)
        self._commit(was, was["segments"], [*was["tombstones"], *stones], was.get("vectors"))
        return True

    def compact(self) -> dict:
        """All live rows in one segment; older versions stay readable."""
        was = self.manifest()
        number = max((s["number"] for s in was["segments"]), default=0) + 1
        path = f"segments/{number:09d}-{uuid.uuid4().hex[:8]}"
        for name in TABLES:
            self.table(name, was).sortWithinPartitions("term" if name == "postings" else "document_id").write.parquet(f"{self.root}/{path}/{name}")
        now = self._commit(was, [{"number": number, "path": path}], [])
        if (same := self._derived(was)) is not None:
            self._point(now, same)
        return now

    def replace_vectors(self, vectors: DataFrame) -> dict:
        """Swaps the vectors of all live documents, and writes nothing else."""
        was = self.manifest()
        before = max((s["number"] for s in was["segments"]), default=0) + 1
        path = f"vectors/{before:09d}-{uuid.uuid4().hex[:8]}"
        shaped(vectors, SCHEMAS["vectors"]).write.parquet(f"{self.root}/{path}")
        return self._commit(was, was["segments"], was["tombstones"], {"path": path, "before": before})

    def reset_vectors(self) -> dict:
        """Takes all vectors out; documents, chunks and the lexical index stay."""
        return self.replace_vectors(self.spark.createDataFrame([], SCHEMAS["vectors"]))

    # -- ingest -----------------------------------------------------------------------

    def ingest_files(self, path: str) -> DataFrame:
        """Reads a folder of files into the store; returns what was refused: original_filename, reason."""
        read = written(read_files(self.spark, path, self.config.max_upload_bytes), "read")
        good = read.filter("error is null").withColumn("source_type", F.lit("upload")).withColumn("source_url", F.lit(None).cast("string")).withColumn("mime_type", mime_of(F.col("source_format")))
        refused = read.filter("error is not null").select("original_filename", F.col("error").alias("reason"))
        return refused.unionByName(self._ingest(good, "original_filename"))

    def ingest_pages(self, pages: DataFrame) -> DataFrame:
        """Reads rows (page_id, url, html) into the store; returns what was refused: url as original_filename, reason."""
        read = written(read_pages(pages), "read")
        good = read.filter("error is null").select(F.lit(None).cast("string").alias("original_filename"), F.col("download_bytes").cast("long").alias("file_size_bytes"), "sha256", "title", F.lit("html").alias("source_format"), F.array(F.struct(F.col("text"), F.lit(0).alias("char_start"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("section_title"), F.create_map(F.lit("source_url"), F.col("url")).alias("metadata"))).alias("segments"), "text", F.create_map(F.lit("source_url"), F.col("url"), F.lit("download_bytes"), F.col("download_bytes").cast("string")).alias("metadata"), F.lit("web").alias("source_type"), F.col("url").alias("source_url"), F.lit(MIME["html"]).alias("mime_type"))
        refused = read.filter("error is not null").select(F.col("url").alias("original_filename"), F.col("error").alias("reason"))
        return refused.unionByName(self._ingest(good, "source_url"))

    def _ingest(self, read: DataFrame, name: str) -> DataFrame:
        """Adds documents whose digest is new; the first of equal ones in a batch. The digest names the document."""
        known = self.table("documents").select("sha256")
        fresh, twice = split_duplicates(read, known, name)
        fresh = written(fresh.dropDuplicates(["sha256"]).withColumn("document_id", F.substring("sha256", 1, 32)), "fresh")
        if not fresh.isEmpty():
            chunks = I.chunk_extracted(fresh, self.config.chunk_size, self.config.chunk_overlap).withColumnRenamed("metadata", "extra_metadata")
            self.add(fresh.withColumnRenamed("metadata", "extra_metadata"), chunks)
        return twice.select(F.col(name).alias("original_filename"), F.lit("the document is already there").alias("reason"))


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema, missing ones null."""
    kinds = [x.strip().split(" ", 1) for x in _columns(schema)]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])


def _columns(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def mime_of(source_format: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])[source_format]


def filtered(documents: DataFrame, source_type: str | None = None, status: str | None = None) -> DataFrame:
    """Equality filters, each only if given."""
    for name, value, allowed in (("source_type", source_type, SOURCE_TYPES), ("status", status, STATUSES)):
        if value is not None:
            check_choice(name, value, allowed)
            documents = documents.filter(F.col(name) == value)
    return documents


def page_of(documents: DataFrame, limit: int, offset: int, by: tuple[str, str] = ("created_at", "document_id")) -> DataFrame:
    return documents.orderBy(*[F.desc(c) for c in by]).offset(offset).limit(limit)


def split_duplicates(rows: DataFrame, known: DataFrame, tie: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose sha256 is new, the first of equal ones; the others)."""
    first = rows.groupBy("sha256").agg(F.min(tie).alias("first_name"))
    marked = rows.join(first, "sha256").join(known.select("sha256", F.lit(True).alias("is_known")).distinct(), "sha256", "left")
    new = F.col("is_known").isNull() & F.col(tie).eqNullSafe(F.col("first_name"))
    extra = ("is_known", "first_name")
    return marked.filter(new).drop(*extra), marked.filter(~new).drop(*extra)


def invalid_documents(documents: DataFrame) -> DataFrame:
    bad = F.coalesce(F.col("file_size_bytes") < 0, F.lit(False)) | (F.col("chunk_count") < 0) | ~F.col("source_type").isin(*SOURCE_TYPES) | ~F.col("status").isin(*STATUSES)
    return documents.filter(bad).select("document_id")


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """hits with their chunk's and document's columns; hits whose chunk is gone are dropped, ranks stay."""
    narrow = documents.select("document_id", "title", "source_type", "original_filename")
    wide = chunks.select("chunk_id", "text", "position", "page_start", "page_end", "section_title")
    return hits.join(wide, "chunk_id").join(narrow, "document_id").withColumn("searchable", X.searchable(F.col("title"), F.col("section_title"), F.col("text")))
