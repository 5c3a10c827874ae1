"""A collection of documents: from files to tables, and queries over the tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import fold
from .operators import answers, catalog, chunks, payloads, records, retrieval, structure, vectors
from .operators.classify import archetypes, domain, primary_structure
from .operators.numbering import numbered
from .operators.search_index import SearchIndex
from .sinks import writers
from .sources.files import blocks_of, parse_files, scan

#: Documents and index lines that the collection's own report shows; the tables have them all.
CATALOG_SHOWN, TREE_SHOWN = 500, 500
PREVIEW_COLUMNS = ("chunk_id", "file_name", "heading", "score", "retrieval_mode", "snippet")
OUTPUTS = ("payloads", "reports")
TABLES = ("documents", "blocks", "entries", "catalog", "master_index", "chunks", "search_records", "embeddings")


def documents_of(parsed: DataFrame, before: int = 0) -> DataFrame:
    """Parsed files that have no fault, as documents: doc_id (hash of the path), seq (by path, after the number before), archetype, domain, primary_structure."""
    fine = archetypes(parsed.where("status = 'ok'"))
    kinds = F.transform("blocks", lambda b: b["kind"])
    rows = fine.withColumns({"doc_id": F.xxhash64("source_path"), "domain": domain(F.col("archetype"), F.col("mode"), kinds), "primary_structure": primary_structure(F.col("mode"), kinds)})
    numbers = numbered(rows.select("doc_id", "source_path"), ["source_path"], "seq").select("doc_id", (F.col("seq") + before).alias("seq"))
    return rows.join(numbers, "doc_id")


class Collection:
    """Tables of a collection under one folder, as Parquet; each is a temp view too, for plain SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        self._finish_replacing(name)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def save(self, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        self._finish_replacing(name)
        df.write.mode(mode).parquet(f"{self.folder}/{name}")
        return self.table(name)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Put df, which may read the table itself, in the table's place: written whole beside it, then moved there.

        A driver that is lost before the new table is whole leaves the old one; one that is lost later leaves the new one
        beside it, with Spark's mark that it is whole, and the next reader moves it.
        """
        self._finish_replacing(name)
        df.write.mode("overwrite").parquet(f"{self.folder}/_{name}_new")
        return self.table(name)

    def _finish_replacing(self, name: str) -> None:
        fs, done = self._at(f"_{name}_new/_SUCCESS")
        if fs.exists(done):
            (_, path), (_, new) = self._at(name), self._at(f"_{name}_new")
            fs.delete(path, True)
            if not fs.rename(new, path):
                raise OSError(f"cannot rename {new} to {path}")

    def write_text(self, name: str, text: str) -> None:
        """A small text file of the collection, such as a report."""
        fs, path = self._at(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, name: str) -> bool:
        self._finish_replacing(name)
        fs, path = self._at(name)
        return fs.exists(path)

    def is_collection(self) -> bool:
        return self.has("catalog") and self.has("documents")

    def register(self) -> None:
        for name in TABLES:
            if self.has(name):
                self.table(name).createOrReplaceTempView(name)

    def ingest(self, source: str, embeddings: bool = False, search: bool = True, build_chunks: bool = True, parsers: Mapping[str, Any] | None = None) -> dict[str, int]:
        """Parse files and derive all tables; returns numbers of files by outcome. parsers: further ones by name, such as
        sources.ocr.image_parser for images."""
        return self.derive(parse_files(scan(self.spark, source), dict(parsers or {})), embeddings, search, build_chunks)

    def derive(self, parsed: DataFrame, embeddings: bool = False, search: bool = True, build_chunks: bool = True) -> dict[str, int]:
        """All tables from parsed files, in place of those that are there, and the outputs."""
        self._drop_index()
        files = self.save("files", parsed)
        made = self._tables(documents_of(files), search, build_chunks)
        for name, df in made:
            self.save(name, df())
        return self._finish(files, embeddings and build_chunks)

    def add(self, parsed: DataFrame, embeddings: bool = False) -> dict[str, int]:
        """Parsed files beside those that are there. Only the new files' rows are derived, and the outputs of their documents.

        They are appended; where a path comes again its document's rows are left out of the tables first, which copies the
        other rows, but derives none anew. Search records are merged within a file name: those of the names that come are
        derived from all documents of these names. Vectors of unchanged chunks are kept. The collection's own counts and
        pages are made from its catalog and index, which have a row for each document and entry.
        """
        if not self.is_collection():
            return self.derive(parsed, embeddings)
        self._drop_index()
        files = self.save("files_added", parsed)
        again = self.table("documents").join(files.select("source_path"), "source_path", "left_semi").select("doc_id")
        last = self.table("documents").agg(F.max("seq")).first()[0] or 0
        last_chunk = (self.table("chunks").agg(F.max("chunk_seq")).first()[0] or 0) if self.has("chunks") else 0
        gone = self.save("replaced", again) if again.limit(1).count() else None
        made = self._tables(documents_of(files, last), False, self.has("chunks"), "_added", last_chunk)
        made += [(name, df) for name, df in self._outputs("_added") if self.has(name)]
        for name, df in made:
            self._put(name, self.save(f"{name}_added", df()), gone)
        if self.has("search_records"):
            self._renew_search_records()
        old = self.table("files").join(files.select("source_path"), "source_path", "left_anti")
        self.replace("files", old.unionByName(files))
        for name in (*(f"{n}_added" for n in (*TABLES, *OUTPUTS, "files")), "replaced"):
            fs, path = self._at(name)
            fs.delete(path, True)
        return self._finish(self.table("files"), embeddings or self.has("embeddings"), False)

    def _put(self, name: str, rows: DataFrame, gone: DataFrame | None) -> None:
        """Rows beside those of a table, without those of the documents that are gone."""
        if gone is None:
            self.save(name, rows, "append")
        else:
            self.replace(name, self.table(name).join(gone, "doc_id", "left_anti").unionByName(rows))

    def _renew_search_records(self) -> None:
        """Search records of the file names that documents_added has."""
        names = self.table("documents_added").select(fold("file_name").alias("_name")).distinct()
        own = self.table("documents").withColumn("_name", fold("file_name")).join(names, "_name", "left_semi").select("doc_id")
        made = self.save("search_records_added", self._search_records("", own)).select(self.table("search_records").columns)
        old = self.table("search_records").withColumn("_name", fold("file_name"))
        if old.join(names, "_name", "left_semi").limit(1).count():
            self.replace("search_records", old.join(names, "_name", "left_anti").drop("_name").unionByName(made))
        else:
            self.save("search_records", made, "append")

    def _outputs(self, ending: str = "") -> list[tuple[str, Callable[[], DataFrame]]]:
        """(name, rows) of what is written for each document."""
        own = lambda name: self.table(name + ending)
        return [
            ("payloads", lambda: payloads.payloads(own("documents"), own("blocks"), own("entries"), own("catalog").select("doc_id", "summary"))),
            ("reports", lambda: writers.reports(own("documents"), own("blocks"), own("entries"))),
        ]

    def _tables(self, documents: DataFrame, search: bool, build_chunks: bool, ending: str = "", last_chunk: int = 0) -> list[tuple[str, Callable[[], DataFrame]]]:
        """(name, rows) of the tables in the order in which they are derived; each reads those before it, under names with the ending."""
        own = lambda name: self.table(name + ending)
        out: list[tuple[str, Callable[[], DataFrame]]] = [
            ("documents", lambda: documents),
            ("blocks", lambda: structure.block_paths(blocks_of(own("documents"), "doc_id")).drop("stack")),
            ("entries", lambda: structure.index_entries(own("documents"))),
            ("catalog", lambda: catalog.catalog(own("documents").select("doc_id", "seq", "file_name", "file_type", "archetype", "source_path").join(self._summaries(ending), "doc_id", "left"), own("entries"), own("blocks"))),
            ("master_index", lambda: catalog.master_index(own("documents"), own("entries"))),
        ]
        if search:
            out.append(("search_records", lambda: self._search_records(ending)))
        if build_chunks:
            out.append(("chunks", lambda: self._chunks(ending, last_chunk)))
        return out

    def _summaries(self, ending: str) -> DataFrame:
        return catalog.document_summaries(*(self.table(name + ending) for name in ("documents", "entries", "blocks")))

    def _search_records(self, ending: str, only: DataFrame | None = None) -> DataFrame:
        """Merged records of all documents, or of those whose doc_id is given."""
        docs, blocks, entries, rows, master = (self.table(name + ending) for name in ("documents", "blocks", "entries", "catalog", "master_index"))
        if only is not None:
            docs, blocks, entries, rows, master = (t.join(only, "doc_id", "left_semi") for t in (docs, blocks, entries, rows, master))
        about = docs.select("doc_id", "seq", "file_name", "file_type", "archetype", "source_path", F.lit(self.folder).alias("output_dir")).join(rows.select("doc_id", "summary"), "doc_id", "left")
        return records.deduplicate(records.search_records(about, blocks, entries, rows, master))

    def _chunks(self, ending: str, before: int = 0) -> DataFrame:
        docs, entries, blocks = (self.table(name + ending) for name in ("documents", "entries", "blocks"))
        made = chunks.with_chunk_ids(chunks.document_chunks(docs, entries, blocks), docs, order="seq", before=before)
        return chunks.chunk_locations(made.join(docs.select("doc_id", "file_name", "file_type", "archetype"), "doc_id"))

    def _finish(self, files: DataFrame, embeddings: bool, documents: bool = True) -> dict[str, int]:
        counts = {r["status"]: r["count"] for r in files.groupBy("status").count().collect()}
        if embeddings:
            self.build_embeddings(documents=documents)
        else:
            self.refresh(documents=documents)
        return counts

    def failures(self) -> DataFrame:
        """source_path, error of the files that could not be parsed."""
        return self.table("files").where("status = 'failed'").select("source_path", "error")

    def refresh(self, profile: str = "legal", documents: bool = True) -> None:
        """Derive the outputs anew: payloads and reports of documents (unless they stand), and the collection's metadata, previews, summary and report."""
        docs, entries, rows, master = (self.table(name) for name in ("documents", "entries", "catalog", "master_index"))
        for name, df in self._outputs():
            if documents or not self.has(name):
                self.save(name, df())
        counts = catalog.collection_counts(rows)
        if self.has("chunks"):
            counts = counts.join(F.broadcast(vectors.embedding_stats(self.chunks()).drop("archetype_counts")), how="full")
        self.save("metadata", counts)
        found = self.preview(profile) if self.has("chunks") else []
        self.write_text("preview.json", writers.json_text([{"query": q, "results": [{k: r.get(k) for k in PREVIEW_COLUMNS} for r in own]} for q, own in found]))
        name, top = self.folder.rsplit("/", 1)[-1], catalog.top_titles(entries.join(docs.select("doc_id", "seq"), "doc_id").select("title", F.struct("seq", "pos").alias("at")), seq="at")
        summary = catalog.collection_summary(name, self.table("metadata"), top, rows, master.count())
        first = [r.asDict() for r in rows.orderBy("seq").limit(CATALOG_SHOWN).collect()]
        tree = "\n".join("  " * (r["level"] - 1) + f"- [{r['kind']}] {r['title']}" for r in master.join(docs.select("doc_id", "seq"), "doc_id").orderBy("seq", "pos").limit(TREE_SHOWN).collect())
        self.write_text("summary.md", writers.collection_markdown(name, summary, first, tree, found))
        self.write_text("report.html", writers.collection_html(name, first, tree, found))

    def build_embeddings(self, force: bool = False, size: int = vectors.VECTOR_SIZE, documents: bool = True) -> dict[str, int]:
        """Vectors of all chunks; stored ones are kept where the chunk's text is the same. The outputs follow."""
        self.ensure_chunks()
        own = self.table("chunks").select("chunk_id", vectors.context_text(self.table("chunks")).alias("context"))
        schema = "chunk_id string, text_fingerprint string, vector array<double>"
        old = self.table("embeddings").select("chunk_id", "text_fingerprint", "vector") if self.has("embeddings") else self.spark.createDataFrame([], schema)
        made = self.replace("embeddings", vectors.build_embeddings(own, old, size, force).select("chunk_id", "text_fingerprint", "vector", "reused"))
        n = made.agg(F.count("vector").alias("embedding_count"), F.count_if("reused").alias("reused_count"), F.count_if(~F.col("reused") & F.col("vector").isNotNull()).alias("built_count"))
        self.refresh(documents=documents)
        return n.first().asDict()

    def ensure_chunks(self) -> DataFrame:
        """The chunks, derived first if the table is missing."""
        return self.table("chunks") if self.has("chunks") else self.save("chunks", self._chunks(""))

    def save_chunks(self, df: DataFrame) -> DataFrame:
        return self.replace("chunks", df)

    def has_embeddings(self) -> bool:
        return self.has("embeddings")

    def embed_query(self, query: str, size: int = vectors.VECTOR_SIZE) -> list[float] | None:
        return vectors.embed_plain(query, size)

    def chunks(self) -> DataFrame:
        own = self.ensure_chunks()
        return vectors.attach(own, self.table("embeddings")) if self.has("embeddings") else own.withColumn("vector", F.lit(None).cast("array<double>"))

    def build_index(self) -> SearchIndex:
        """Index the search records as they are now, so that searches read what their words need; it is dropped when records change."""
        index = SearchIndex(self.spark, f"{self.folder}/search_index").build(self.table("search_records"))
        self.write_text("search_index/built", "")
        return index

    def _drop_index(self) -> None:
        fs, path = self._at("search_index")
        fs.delete(path, True)

    def search(self, query: str, filters: Mapping[str, Any] | None = None, limit: int = 10, profile: str = "legal") -> DataFrame:
        """The best records: from the index if there is one, else by a scan."""
        if self.has("search_index/built"):
            return SearchIndex(self.spark, f"{self.folder}/search_index").search(query, filters, limit, profile)
        return retrieval.search_records(self.table("search_records"), query, filters, limit, profile)

    def search_file(self, query: str, file_name: str, limit: int = 10) -> DataFrame:
        """Records of one file, by the legal profile."""
        return self.search(query, {"file_name": file_name}, limit, "legal")

    def query(self, query: str, filters: Mapping[str, Any] | None = None, limit: int = 6, profile: str = "legal") -> DataFrame:
        return retrieval.search_chunks(self.chunks(), query, filters, limit, profile)

    def context(self, query: str, persist: bool = False, **more: Any) -> dict[str, Any]:
        """Ranked chunks with their context; persist writes them as query_results.json."""
        rows = retrieval.context_lines(self.query(query, **more)).orderBy("rank").collect()
        mode = "hybrid" if any(r["retrieval_mode"] == "hybrid" for r in rows) else "textual"
        out = {"query": query, "filters": dict(more.get("filters") or {}), "chunks": [{k: v for k, v in r.asDict(True).items() if k != "vector"} for r in rows], "context_text": "\n\n".join(r["context"] for r in rows), "mode": mode, "ranking_profile": more.get("profile", "legal"), "total_hits": len(rows)}
        if persist:
            self.write_text("query_results.json", writers.json_text(out))
        return out

    def answer(self, query: str, model: answers.Model | None, filters: Mapping[str, Any] | None = None, limit: int = 6, profile: str = "legal", missing: Sequence[str] = (), persist: bool = False) -> answers.Answer:
        """An answer from what the query finds; persist writes answer_results.json and answer_results.md."""
        found = self.query(query, filters, limit, profile)
        order = [F.desc("score"), F.desc("text_score"), F.desc("vector_score"), F.col("text_length"), F.col("file_name"), F.col("heading_path_text"), F.col("chunk_id")]
        rows = [{k: v for k, v in r.asDict(True).items() if k != "vector"} for r in answers.grounding(found, order).orderBy("id").collect()]
        mode = "hybrid" if any(r["retrieval_mode"] == "hybrid" for r in rows) else "textual"
        out = answers.answer(query, rows, model, filters, mode, profile, missing)
        if persist:
            self.write_text("answer_results.json", writers.json_text({"query": query, "status": out.status, "answer": out.text, "citations": out.citations, "error": out.error, "grounding": [{k: g.get(k) for k in ("id", "reference", "score", "retrieval_mode", "text")} for g in out.grounding]}))
            self.write_text("answer_results.md", writers.answer_markdown(query, out, out.grounding))
        return out

    def preview(self, profile: str = "legal", per_query: int = 3) -> list[tuple[str, list[dict]]]:
        """The preview queries and the best chunks of each, reranked; one scan finds the candidates of all."""
        return [(q, [r.asDict(True) for r in df.collect()]) for q, df in retrieval.preview(self.chunks(), profile, per_query)]


def latest(spark: SparkSession, root: str) -> Collection | None:
    """The collection of a folder of collections whose name comes last (names begin with their time)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), reverse=True)
    return next((own for n in names if (own := Collection(spark, f"{root.rstrip('/')}/{n}")).is_collection()), None)
