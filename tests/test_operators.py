import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import evaluate_folder
from quarry.config import EngineConfig, bm25_parameters, prf_options
from quarry.engine import Engine
from quarry.functions import vectors
from quarry.operators import catalog, dense, evaluation, feedback, fusion, index, lexical, rag, rerank, views
from quarry.sources import files, web


def corpus(spark, *rows):
    return spark.createDataFrame([(c.split("-")[0] if "-" in c else c, c, t) for c, t in rows], "document_id string, chunk_id string, text string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def ids(hits, q=0):
    return [r["chunk_id"] for r in hits.filter(F.col("query_id") == q).orderBy("rank").collect()]


@pytest.fixture(scope="module")
def three(spark):
    return index.build(corpus(spark, ("a-1", "vector retrieval retrieval cosine ranking"), ("a-2", "database transactions and storage"), ("b-1", "probabilistic BM25 ranking model"), ("b-2", "the of and")), stem=True)


def test_tfidf(spark, three):
    hits = lexical.search_tfidf(ask(spark, "cosine retrieval", "zebra"), three, 10, "exact")
    top = hits.orderBy("query_id", "rank").first()
    assert top["chunk_id"] == "a-1" and set(top["term_contributions"]) == {"cosin", "retriev"} and 0 < top["score"] <= 1
    assert hits.filter("query_id = 1").count() == 0
    stats = three.stats.first()
    assert (stats["n_documents"], stats["n_chunks"]) == (2, 4)  # a chunk without terms counts


def test_bm25_properties(spark):
    rare = index.build(corpus(spark, ("a", "retrieval ranking"), ("b", "retrieval ranking quokka"), ("c", "retrieval storage")))
    first = lexical.search_bm25(ask(spark, "retrieval quokka"), rare, 3, "exact").orderBy("rank").first()
    assert first["chunk_id"] == "b" and first["term_contributions"]["quokka"] > first["term_contributions"]["retrieval"]
    more = index.build(corpus(spark, ("x", "signal"), ("y", "signal " * 10)))
    got = {r["chunk_id"]: r["score"] for r in lexical.search_bm25(ask(spark, "signal"), more, 2, "exact", b=0.0).collect()}
    assert 1 < got["y"] / got["x"] < 2.5
    long = index.build(corpus(spark, ("short", "signal"), ("long", "signal " + " ".join(f"word{i}" for i in range(19)))))
    assert ids(lexical.search_bm25(ask(spark, "signal"), long, 2, "exact", b=1.0)) == ["short", "long"]
    tie = index.build(corpus(spark, ("chunk-b", "equal signal"), ("chunk-a", "equal signal")))
    assert ids(lexical.search_bm25(ask(spark, "signal"), tie, 1, "exact")) == ["chunk-a"]
    for bad in ({"k1": 0.0}, {"b": 1.1}, {"top_k": 0}, {"mode": "x"}):
        with pytest.raises(ValueError):
            lexical.search_bm25(ask(spark, "signal"), tie, **bad)


def test_champions(spark):
    graded = index.build(corpus(spark, *[(f"chunk-{i:02d}", "alpha beta gamma " + "signal " * i) for i in range(1, 21)]), champion_size=8)
    q = ask(spark, "signal")
    got = lexical.search_detailed(q, graded, "bm25", 3, "champion", compare_exact=True)
    assert ids(got.hits) == ids(lexical.search_bm25(q, graded, 3, "exact"))
    said = got.diagnostics.first()
    assert said["postings_visited"] < said["postings_available"] and said["exact_top_k_overlap"] == 1.0 and not said["fallback_occurred"]
    few = index.build(corpus(spark, *[(f"s-{i}", "signal ranking") for i in range(10)], *[(f"t-{i}", "quokka") for i in range(3)]), champion_size=2)
    assert ids(lexical.search_bm25(ask(spark, "quokka"), few, 10, "champion")) == ids(lexical.search_bm25(ask(spark, "quokka"), few, 10, "exact"))
    assert len(ids(lexical.search_bm25(ask(spark, "quokka"), few, 10, "champion", fallback=False))) == 2


def test_feedback(spark):
    built = index.build(corpus(spark, ("feedback", "neural neural neural ranking quokka quokka quokka"), ("also", "neural ranking"), ("mismatch", "quokka embeddings vector space"), ("noise", "boolean transactions storage")))
    q = ask(spark, "neural", "zebra")
    assert "mismatch" not in ids(lexical.search_tfidf(q, built, 10, "exact"))
    wide = feedback.search_with_feedback(q, built, 10, 2, 10, mode="exact")
    assert "mismatch" in ids(wide.hits) and wide.hits.filter("query_id = 1").isEmpty() and wide.terms.filter("query_id = 1").isEmpty()
    plain = {r["chunk_id"]: r["score"] for r in lexical.search_tfidf(q, built, 10, "exact").collect()}
    same = feedback.search_with_feedback(q, built, 10, 2, 10, beta=0.0, mode="exact")
    assert {r["chunk_id"]: r["score"] for r in same.hits.collect()} == plain and same.terms.filter("added").isEmpty()


def test_question_terms_and_feedback_reach_the_scan(spark, monkeypatch):
    built = index.build(corpus(spark, *[(f"c-{i:03d}", f"signal word{i} word{i + 1}") for i in range(90)]))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,word7)" in plan(lexical.search_bm25(ask(spark, "word7"), built, 3, "exact"))
    chosen = spark.createDataFrame([(0, "c-003"), (0, "c-005")], "query_id int, chunk_id string")
    got = feedback.centroids(chosen, built)
    assert "EqualTo(chunk_id,c-005)" in plan(got)
    assert {r["term"] for r in got.collect()} == {"signal", "word3", "word4", "word5", "word6"}
    many, held = lexical.held(built.terms, rows=10)
    assert held is None and many is built.terms and lexical.held(built.terms)[0].count() == 92
    # whether rows are held and pushed or shuffled, what meets is the same
    asked = spark.createDataFrame([("word3", 1), ("word3", 2), ("nowhere", 3), (None, 4)], "term string, n int")
    met = lambda: sorted((r["chunk_id"], r["n"]) for r in lexical.meet(built.scored, asked, "term").collect())
    assert met() == [("c-002", 1), ("c-002", 2), ("c-003", 1), ("c-003", 2)]
    assert lexical.meet(built.scored, asked.limit(0), "term").isEmpty()
    monkeypatch.setattr(lexical, "held", lambda df: (df, None))
    assert met() == [("c-002", 1), ("c-002", 2), ("c-003", 1), ("c-003", 2)]


def test_derived_tables_are_read_once_made(spark, tmp_path, monkeypatch):
    config = EngineConfig(root=f"file://{tmp_path}/store", chunk_size=20, chunk_overlap=5)
    page = lambda i, words: spark.createDataFrame([(i, f"http://e.org/{i}", f"<title>T</title><article><p>{words}</p></article>")], "page_id long, url string, html string")
    engine = Engine(spark, config)
    engine.ingest_pages(page(1, "Databases keep transactions on disk.")).collect()
    first = engine.search_bm25("transactions").first()
    made = []
    derive = index.derive
    monkeypatch.setattr(index, "derive", lambda *a: made.append(1) or derive(*a))
    again = Engine(spark, config)
    assert again.search_bm25("transactions").first()["score"] == first["score"] and not made
    again.reset_vectors()
    again.store.compact()
    assert not Engine(spark, config).search_tfidf("transactions").isEmpty() and not made  # the same rows, other segments
    again.ingest_pages(page(2, "Rankings rest on cosines and transactions.")).collect()
    assert again.search_bm25("transactions").count() == 2 and len(made) == 1
    assert Engine(spark, EngineConfig(root=config.root, chunk_size=20, chunk_overlap=5, stem=False)).search_bm25("transaction").isEmpty() and len(made) == 2
    again.store.roll_back()
    again._forget()
    assert again.search_bm25("transactions").count() == 1 and len(made) == 2
    monkeypatch.setattr(index, "derive", lambda *a: a[-1](a[0].groupBy("term").count().withColumnRenamed("count", "df"), "terms") and 1 / 0)
    again.ingest_pages(page(3, "Nothing else is left.")).collect()
    with pytest.raises(ZeroDivisionError):
        again.search_bm25("left")
    monkeypatch.setattr(index, "derive", derive)
    assert again.search_bm25("left").count() == 1


def test_nearest(spark):
    rows = spark.createDataFrame([("z-near", [-0.5, 0.75**0.5]), ("a-far", [-0.9, 0.19**0.5]), ("zero", [0.0, 0.0]), ("none", None)], "chunk_id string, embedding array<double>")
    got = dense.nearest(rows, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>"), 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["zero", "z-near", "a-far"] and [r["score"] for r in got] == [0.0, 0.0, 0.0] and got[2]["distance"] > 1
    assert [r["chunk_id"] for r in dense.nearest_to(rows.filter("embedding is not null"), [1.0, 0.0], 2).collect()] == ["zero", "z-near"]
    table = spark.createDataFrame([("old-a", "a"), ("old-b", "a"), ("other", "b")], "chunk_id string, document_id string")
    after, stale = dense.upserted(table, spark.createDataFrame([("new-a", "a")], "chunk_id string, document_id string"))
    assert {r[0] for r in after.select("chunk_id").collect()} == {"new-a", "other"} and {r[0] for r in stale.collect()} == {"old-a", "old-b"}


def arm(spark, *names):
    return spark.createDataFrame([(0, i + 1, n, 0.5) for i, n in enumerate(names)], "query_id long, rank int, chunk_id string, score double")


def test_fusion(spark):
    got = {r["chunk_id"]: r["fusion_score"] for r in fusion.fused(arm(spark, "a", "b"), arm(spark, "b", "c")).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})
    assert ids(fusion.fused(arm(spark, "zeta"), arm(spark, "alpha"))) == ["alpha", "zeta"]
    row = fusion.fused(arm(spark, "a"), arm(spark, "b")).filter("chunk_id = 'a'").first()
    assert row["bm25_score"] is None and row["retrieval_sources"] == ["dense"]
    assert [r["chunk_id"] for r in fusion.to_hydrate(fusion.fused(arm(spark, "a"), arm(spark, "b")), arm(spark, "a")).collect()] == ["b"]


def test_gate_and_pin(spark):
    built = index.build(corpus(spark, ("w", "the wiki page"), ("o", "other words"), ("s", "bonus points are awarded"), *[(f"f{i}", f"filler number{i}") for i in range(7)]))
    q = ask(spark, "bonus points awarded", "bonus points awarded on Mars Venus Pluto Saturn", "what does it do")
    pool = spark.createDataFrame([(i, r + 1, c, t, None, s, 0.1) for i in range(3) for r, (c, t, s) in enumerate([("w", "the wiki page", None), ("o", "other words", None), ("s", "bonus points are awarded", 4.2)])], "query_id long, rank int, chunk_id string, searchable string, dense_score double, bm25_score double, fusion_score double")
    rows = fusion.with_evidence(pool, q, built)
    got = {(r["query_id"], r["chunk_id"]): r for r in rows.collect()}
    assert got[0, "s"]["strong"] and got[0, "s"]["coverage"] == 1.0 and not got[1, "s"]["strong"] and got[2, "s"]["coverage"] is None
    assert got[1, "s"]["coverage"] < 0.6 and got[0, "s"]["relative_bm25"] == 1.0 and got[0, "w"]["relative_bm25"] is None
    chosen = fusion.select_context(rows, 2)
    assert ids(chosen, 0) == ["w", "s"] and ids(chosen, 1) == ["w", "o"]
    verdicts = {r["query_id"]: (r["passes"], r["reason"]) for r in fusion.gate(chosen, q.unionByName(spark.createDataFrame([(9, "x")], "query_id long, text string"))).collect()}
    assert verdicts == {0: (True, None), 1: (False, "low_relevance"), 2: (False, "low_relevance"), 9: (False, "no_context")}


def test_rerank(spark):
    class Longest:
        def predict(self, pairs):
            return [float(len(t)) for _, t in pairs]

    def broken():
        raise OSError("no model")

    hits = spark.createDataFrame([(0, i + 1, f"c{i:02d}", "x" * i) for i in range(30)], "query_id long, rank int, chunk_id string, text string")
    got = rerank.rerank(hits, ask(spark, "q"), Longest, 10)
    assert ids(got) == [f"c{i}" for i in range(24, 14, -1)]
    assert ids(rerank.rerank(hits, ask(spark, "q"), broken, 2)) == ["c00", "c01"] and ids(rerank.rerank(hits, ask(spark, "q"), None, 2)) == ["c00", "c01"]


class Said:
    def __init__(self, *answers):
        self.answers = list(answers)

    def generate(self, system, user):
        got = self.answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got


@pytest.mark.parametrize("answers,reason,text", [
    (["A [1].", "A [1]."], None, "A [1]."),
    (["INSUFFICIENT_EVIDENCE"], "model_abstained", ""),
    (["no marker", "again none"], "citation_failure", ""),
    (["no marker", "B [2].", "B. [2]"], None, "B [2]."),
    (["A [1].", "INSUFFICIENT_EVIDENCE"], "grounding_failure", ""),
    (["A [1].", "A [1]. Loose end."], "citation_failure", ""),
])
def test_answers(answers, reason, text):
    got = rag.answer("q", "ctx", 2, Said(*answers))
    assert (got.reason, got.answer) == (reason, text)


def test_rewrite_falls_back():
    assert rag.rewrite("q", Said(rag.ModelError("x"))) == "q" and rag.rewrite("q", Said("Query: better")) == "better"
    model = rag.HttpModel("http://x", "m", send=lambda u, h, b: {"message": {"content": "<think>a</think>"}})
    with pytest.raises(rag.ModelError):
        model.generate("s", "u")


def test_metrics(spark):
    ranking = spark.createDataFrame([(0, 1, "a"), (0, 2, "x"), (0, 3, "b"), (1, 1, "x")], "query_id long, rank int, chunk_id string")
    qrels = spark.createDataFrame([(0, "a"), (0, "b"), (1, "z")], "query_id long, chunk_id string")
    got = {r["query_id"]: r for r in evaluation.metrics(ranking, qrels, ask(spark, "p", "q", "r"), 4).collect()}
    assert got[0]["precision"] == 0.5 and got[0]["reciprocal_rank"] == 1 and got[0]["ndcg"] == pytest.approx(1.5 / (1 + 1 / 1.584962500721156))
    assert (got[1]["precision"], got[1]["ndcg"], got[2]["ndcg"]) == (0, 0, 0)
    assert evaluation.rank_positions(ranking, qrels).first().asDict() == {"rank_1": 1, "rank_2": 0, "rank_3": 1, "rank_4": 0, "missed": 1}
    cells = [{"k1": 0.9, "b": 0.3, "ndcg": 0.9, "reciprocal_rank": 0.9}, {"k1": 1.5, "b": 0.75, "ndcg": 0.9, "reciprocal_rank": 0.9}, {"k1": 2.0, "b": 0.3, "ndcg": 0.8, "reciprocal_rank": 1.0}]
    assert evaluation.select_parameters(cells) == (1.5, 0.75) and evaluation.select_parameters(cells[::2]) == (0.9, 0.3)
    text = evaluation.report({"Core": [{"a": 1.0}]}, "# x\n\n## Sweep\n\nkept\n")
    assert "## Sweep\n\nkept" in text and "| 1.000 |" in text


def test_views(spark, three):
    hits = lexical.search_bm25(ask(spark, "ranking model retrieval"), three, 5, "exact")
    cells = views.heat_map(hits)
    assert cells.agg(F.max("share")).first()[0] == 1.0
    nodes = views.graph_nodes(views.document_scores(hits)).collect()
    assert len(nodes) == 2 and nodes[0]["y"] == pytest.approx(60) and views.graph_edges(views.document_scores(hits)).first()["weight"] == 1.0


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(p if p.startswith("<") else f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def heading(text):
    return f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def pdf(*pages):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>"]
    out = b"%PDF-1.4\n"
    for i, text in enumerate(pages):
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>")
        objects.append(zlib.compress(f"BT (First \\(line\\)) Tj T* [({text})] TJ ET".encode()))
    for n, body in enumerate(objects, 1):
        data = body.encode() if isinstance(body, str) else b"<< /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream"
        out += b"%d 0 obj\n" % n + data + b"\nendobj\n"
    return out + b"trailer << /Info << /Title (A title) >> >>"


def test_files():
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Term</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Weight</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    got = files.read_document("x.DOCX", docx("intro", heading("Vector Model"), "text", table, heading("Second"), "more"))
    assert [s["section_title"] for s in got["segments"]] == [None, "Vector Model", "Second"] and "Term | Weight" in got["segments"][1]["text"] and got["title"] == "x"
    read = files.read_document("y.PDF", pdf("one", "two"))
    assert [(s["page_number"], s["text"]) for s in read["segments"]] == [(1, "First (line)\none"), (2, "First (line)\ntwo")] and read["title"] == "A title" and read["metadata"]["page_count"] == "2"
    for name, data, kind in (("a.txt", b"", files.UnsupportedFile), ("a.docx", b"zip", files.UnreadableFile), ("a.pdf", b"%PDF-1.4", files.UnreadableFile), ("a.pdf", b"%PDF-1.4 /Encrypt", files.UnreadableFile)):
        with pytest.raises(kind):
            files.read_document(name, data)


def test_pages_are_read_from_top_to_bottom():
    content = rb"""q 1 0 0 1 0 100 cm BT 1 0 0 1 72 20 Tm (foot) Tj ET Q
BT /F1 9 Tf 1 0 0 1 300 700 Tm (right) Tj 1 0 0 1 72 700.5 Tm (le) Tj [(f) -20 (t)] TJ 12 TL T* (below) Tj (next) ' 0 -12 TD (then) Tj T* (last) Tj ET
/Span << /ActualText (Q Td not shown) >> BDC BT 72 750 Td (he\(a\)d) Tj ET"""
    assert files.reading_order(content) == "he(a)d\nleft right\nbelow\nnext\nthen\nlast\nfoot"
    assert files.reading_order(b"") == "" and files.reading_order(b"BT (a) Tj T* (b) Tj ET") == "a\nb"
    words = pdf("/Encrypt 1 0 R is a word of this page")
    assert "/Encrypt" in files.read_document("w.pdf", words)["segments"][0]["text"]
    with pytest.raises(files.UnreadableFile, match="password"):
        files.read_document("w.pdf", words.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"))


def test_web():
    title, text = web.main_text("<html><head><title> A  b </title><script>x</script></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Head</h1><p>One<p>Two &amp; three<table><tr><td>a<td>b</table></article></body>")
    assert title == "A b" and "menu" not in text and "buy" not in text and text.startswith("Head") and "Two & three" in text and "a | b" in text
    for bad in ("ftp://x.org", "http://", "http://127.0.0.1/", "http://[::1]/", "http://10.0.0.1", "http://x.local"):
        with pytest.raises(web.FetchError):
            web.check_url(bad, lambda _: ["192.168.0.1"])
    assert web.check_url("https://x.org/a", lambda _: ["93.184.216.34"])
    hops = {"http://a.org/": web.Response(302, {"location": "/b"}, b""), "http://a.org/b": web.Response(200, {}, b"ok"), "http://l.org/": web.Response(302, {"location": "http://l.org/"}, b""), "http://e.org/": web.Response(404, {}, b""), "http://big.org/": web.Response(200, {}, bytes(5 * 1024 * 1024 + 1)), "http://in.org/": web.Response(302, {"location": "http://127.0.0.1/"}, b"")}
    public = lambda _: ["93.184.216.34"]
    assert web.fetch("http://a.org/", hops.get, public) == ("http://a.org/b", b"ok")
    for bad in ("http://l.org/", "http://e.org/", "http://big.org/", "http://in.org/"):
        with pytest.raises(web.FetchError):
            web.fetch(bad, hops.get, public)


def test_store_and_engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bonus.docx").write_bytes(docx(heading("Rules"), "Bonus points are awarded for early submission of the work."))
    (tmp_path / "in" / "copy.docx").write_bytes((tmp_path / "in" / "bonus.docx").read_bytes())
    (tmp_path / "in" / "ranking.pdf").write_bytes(pdf("Ranking uses cosine similarity"))
    (tmp_path / "in" / "bad.pdf").write_bytes(b"nothing")
    engine = Engine(spark, EngineConfig(root=f"file://{tmp_path}/store", chunk_size=20, chunk_overlap=5))
    refused = {r["original_filename"]: r["reason"] for r in engine.ingest_files(f"file://{tmp_path}/in").collect()}
    assert set(refused) == {"copy.docx", "bad.pdf"} and engine.health()["store_version"] == 1
    page = [(1, "http://e.org/x", "<title>Storage</title><article><p>Databases keep transactions on disk.</p></article>"), (2, "http://e.org/y", "<script>1</script>")]
    engine.ingest_pages(spark.createDataFrame(page, "page_id long, url string, html string")).collect()
    rows, total = engine.list_documents(2)
    assert total == 3 and len(rows.collect()) == 2 and engine.list_documents(source_type="web")[1] == 1
    assert sum(p.count() for p in engine.store.every_page(2)) == 3
    hit = engine.search_bm25("bonus points").first()
    assert hit["section_title"] == "Rules" and hit["chunk_id"].endswith("-00000")
    assert engine.search_tfidf("cosine ranking", use_prf=True).orderBy("rank").first()["page_start"] == 1
    assert engine.search_semantic("databases", 1).count() == 1 and engine.keyword_stats()["document_count"] == 3
    got = engine.rag("When are bonus points awarded?")
    assert not got["abstained"] and got["answer"].endswith("[1].") and len(got["cited_chunks"]) == 1
    with pytest.raises(ValueError):
        engine.reindex_vectors()
    assert engine.reindex_vectors(overwrite=True)["complete"]
    doc = hit["document_id"]
    assert engine.delete_document(doc) and not engine.delete_document(doc) and engine.search_bm25("bonus").isEmpty()
    engine.store.roll_back()
    engine._forget()
    assert not engine.search_bm25("bonus").isEmpty()
    before = engine.store.stats()["vector_count"]
    engine.reset_vectors()
    assert before == 3 and engine.vector_stats()["chunk_count"] == 0 and engine.search_semantic("databases").isEmpty() and not engine.search_bm25("transaction").isEmpty()
    engine.reindex_vectors()
    engine.store.compact()
    assert engine.vector_stats()["chunk_count"] == 3 and engine.store.stats()["document_count"] == 3 and catalog.invalid_documents(engine.store.table("documents")).isEmpty() and index.invalid_chunks(engine.store.table("chunks")).isEmpty()


class Counted:
    """Documents about ranks or about storage."""

    def embed_documents(self, texts):
        return [[1.0, 0.0] if "rank" in t else [0.0, 1.0] for t in texts]

    def embed_query(self, text):
        return self.embed_documents([text])[0]


def test_engine_stems_and_embeds_as_configured(spark, tmp_path):
    vectors.register_embedder("counted", Counted)
    pages = [(1, "http://e.org/r", "<title>R</title><article><p>The RETRIEVAL systems are retrieving ranked documents.</p></article>"), (2, "http://e.org/s", "<title>S</title><article><p>Stored rows on disk.</p></article>")]
    engine = Engine(spark, EngineConfig(root=f"file://{tmp_path}/a", embedder="counted"))
    engine.ingest_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    hit = engine.search_bm25("retrieve").first()
    assert hit["title"] == "R" and hit["matched_terms"] == ["retriev"] and engine.search_tfidf("storing").first()["title"] == "S"
    assert engine.search_semantic("ranking", 1).first()["title"] == "R" and engine.search_semantic("disk", 1).first()["title"] == "S"
    evidence = fusion.coverage(ask(spark, "retrieved system"), spark.createDataFrame([(0, "c", "retrieving systems")], "query_id long, chunk_id string, searchable string"), engine.index).first()
    assert evidence["coverage"] == 1.0 and evidence["all_terms"]
    plain = Engine(spark, EngineConfig(root=f"file://{tmp_path}/b", stem=False))
    plain.ingest_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert plain.search_bm25("retrieve").isEmpty() and not EngineConfig.from_env({"QUARRY_STEM": "false"}).stem
    with pytest.raises(ValueError):
        vectors.with_vectors(ask(spark, "x"), "text", "unknown", 8)


def test_answers_without_a_lexical_index(spark, tmp_path):
    """Where no chunk has a term, the dense arm alone is the pool."""
    engine = Engine(spark, EngineConfig(root=f"file://{tmp_path}/c"))
    engine.ingest_pages(spark.createDataFrame([(1, "http://e.org/", "<article><p>the of and to</p></article>")], "page_id long, url string, html string")).collect()
    assert engine.keyword_stats()["posting_count"] == 0
    got = engine.rag("the of and")
    assert len(got["context_chunks"]) == 1


@pytest.mark.parametrize("bad", [{"feedback_docs": 51}, {"expansion_terms": 101}, {"max_expansion_terms": 101}])
def test_request_bounds(bad):
    with pytest.raises(ValueError):
        prf_options(EngineConfig(), **bad)
    with pytest.raises(ValueError):
        bm25_parameters(None, 10.5, None)


GOLD = {
    "ranking.txt": "Cosine similarity ranks documents by the angle between weighted term vectors. Length normalisation keeps long texts from winning.",
    "probability.txt": "The probabilistic model saturates term frequency, and its two parameters tune saturation and length normalisation.",
    "feedback.txt": "Pseudo relevance feedback widens a question with frequent words of the first hits, which helps against vocabulary mismatch.",
    "champions.txt": "Champion lists keep the postings with the highest counts, so that candidates are few and ranking is fast.",
}
ASKED = [
    ("cosine similarity of vectors", ["ranking.txt"], "exact vocabulary"), ("pseudo relevance feedback", ["feedback.txt"], "exact vocabulary match on vocabulary mismatch"), ("champion lists", ["champions.txt"], ""),
    ("length normalisation", ["ranking.txt", "probability.txt"], ""), ("saturates term frequency", ["probability.txt"], ""),
    ("ranked by angles", ["ranking.txt"], "vocabulary mismatch: other forms"), ("questions widened by hits", ["feedback.txt"], "vocabulary mismatch"), ("tuning a probabilistic parameter", ["probability.txt"], "vocabulary mismatch"),
    ("posting with a high count", ["champions.txt"], "vocabulary mismatch"), ("normalising lengths", ["ranking.txt", "probability.txt"], "vocabulary mismatch"), ("candidate lists and the rankings of documents", ["champions.txt", "ranking.txt"], "vocabulary mismatch"),
    ("zebra migration", [], "true negative"),
]


def test_evaluation_over_a_folder(spark, tmp_path):
    """Four texts, twelve queries, three splits: lexical methods find all that is relevant first, and nothing where nothing is."""
    (tmp_path / "texts").mkdir()
    for name, text in GOLD.items():
        (tmp_path / "texts" / name).write_text(text)
    (tmp_path / "gold.json").write_text(json.dumps([{"query": q, "relevant_files": f, "note": n} for q, f, n in ASKED]))
    tables = evaluate_folder(spark, f"{tmp_path}/texts", f"{tmp_path}/gold.json", f"{tmp_path}/report.md", True, config=EngineConfig())
    for title, n, precision in (("Exact vocabulary", 5, 0.3), ("Vocabulary mismatch", 6, 1 / 3)):
        rows = {r["method"]: r for r in tables[title]}
        assert set(rows) == {"TF-IDF", "TF-IDF + PRF", "BM25", "Semantic"} and all(r["n_queries"] == n for r in rows.values())
        assert rows["TF-IDF + PRF"]["precision"] == pytest.approx(precision) and rows["TF-IDF + PRF"]["ndcg"] > 0.9
        for method in ("TF-IDF", "BM25"):
            assert (rows[method]["precision"], rows[method]["reciprocal_rank"], rows[method]["ndcg"]) == pytest.approx((precision, 1.0, 1.0)), (title, method)
    lexical_rows = [r for r in tables["Nothing relevant"] if r["method"] != "Semantic"]
    assert all(r["precision"] == r["reciprocal_rank"] == r["ndcg"] == 0 for r in lexical_rows)
    assert tables["Ranks of relevant texts, BM25"] == [{"rank_1": 11, "rank_2": 3, "rank_3": 0, "rank_4": 0, "missed": 0}]
    assert len(tables["BM25 sweep"]) == 16 and tables["Selected"] == [{"k1": 1.5, "b": 0.75}]
    standard = next(r for r in tables["BM25 sweep"] if (r["k1"], r["b"]) == (1.5, 0.75))
    assert (standard["ndcg"], standard["reciprocal_rank"], standard["precision"]) == pytest.approx((11 / 12, 11 / 12, 14 / 48))
    assert "## Vocabulary mismatch" in (tmp_path / "report.md").read_text()


def test_empty_tables(spark):
    built = index.build(spark.createDataFrame([], "document_id string, chunk_id string, text string"))
    assert built.stats.first()["n_chunks"] == 0 and lexical.search_bm25(ask(spark, "x"), built, 3).isEmpty() and lexical.search_tfidf(ask(spark, "x"), built, 3, "exact").isEmpty()


def test_a_search_makes_only_the_tables_it_needs(spark):
    """What build returns ranks as written tables do, and leaves out norms and postings in ranges where nothing asks for them."""
    built = index.build(corpus(spark, *[(f"c-{i}", f"signal word{i % 3} ranking") for i in range(9)]))
    assert not {"lengths", "terms", "norms", "scored"} & set(vars(built))
    asked = spark.createDataFrame([(1, "signal word1 nowhere")], "query_id long, text string")
    hits = lambda i: [(r["rank"], r["chunk_id"], r["score"]) for r in lexical.search_bm25(asked, i, 4, "exact").orderBy("rank").collect()]
    got = hits(built)
    assert not {"norms", "champions", "forward", "scored"} & set(vars(built))
    assert got == hits(index.derive(built.postings, built.lengths)) and [x[1] for x in got[:3]] == ["c-1", "c-4", "c-7"]


def test_a_task_passes_on_only_what_may_be_among_the_best(spark, monkeypatch):
    words = [f"w{i:03d}" for i in range(120)]
    texts = [" ".join(words[(i * 7 + j * j) % 120] for j in range(3 + i % 17)) for i in range(400)] + ["w001 w002 w003"] * 300  # copies tie
    rows = corpus(spark, *[(f"c-{(i * 611) % 700:03d}", t) for i, t in enumerate(texts)]).repartition(3)
    q = ask(spark, *[" ".join(words[i : i + 30]) for i in range(0, 120, 10)], "w001 w002", "nowhere")
    made = []
    contenders = lexical.contenders
    monkeypatch.setattr(lexical, "contenders", lambda *a: made.append(contenders(*a)) or made[-1])
    shown = lambda hits: [tuple(r) for r in hits.orderBy("query_id", "rank").collect()]
    runs = {
        "bm25": lambda i: shown(lexical.search_bm25(q, i, 5, "exact")), "tfidf": lambda i: shown(lexical.search_tfidf(q, i, 5, "exact")),
        "champion": lambda i: shown(lexical.search_bm25(q, i, 5, "champion")), "diagnostics": lambda i: sorted(map(tuple, lexical.diagnostics(q, i, 5).collect())),
    }
    built = index.build(rows, champion_size=8)
    got = {name: run(built) for name, run in runs.items()}
    # at most 5 chunks of a query and task, and 5 by the same counts of those that tie with the last
    assert len(made) == 2 and all(m.select("wn", "chunk_id").count() < 0.5 * built.counted.count() for m in made) and "postings" not in built.__dict__
    plain = index.derive(index.postings_of(rows), index.lengths_of(rows), champion_size=8)
    assert got == {name: run(plain) for name, run in runs.items()}
    assert {r["term"]: r["df"] for r in built.terms.collect()} == {r["term"]: r["df"] for r in built.df_of(words).collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with no text, odd white space, and more words than a chunk has."""
    texts = ["", None, "   ", "Alpha beta's  ALPHA　alpha\x1cgamma\x85delta ", " ".join(f"w{i % 37} " for i in range(40)), "\n" + "it's\x1d one of\xa0them " * 20, "one two three four five six seven eight"]
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string").repartition(3)


def test_terms_and_their_outer_places_are_made_without_a_table(spark, odd, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    places = index.postings_of(index.chunk_documents(odd, 8, 3))
    want = rows(places.select("term", "chunk_id", "tf", F.element_at("positions", 1), F.element_at("positions", -1)))
    monkeypatch.setattr(index, "written", None)
    assert rows(index.build_documents(odd, 8, 3).spans) == want and len(want) > 100


def test_sizes_of_chunks_are_those_of_bags(spark, odd, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(index.bags_of(index.chunk_documents(odd, 8, 3)).select("chunk_id", "document_id", "length", F.size("terms")))
    monkeypatch.setattr(index, "written", None)
    built = index.build_documents(odd, 8, 3)
    assert rows(built.sizes) == want and len({d for _, d, _, _ in want}) == 4


def test_an_index_of_documents_has_the_hits_of_one_of_chunks(spark, odd, monkeypatch):
    q = ask(spark, "alpha gamma", "w1 w2 eight")
    shown = lambda i: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in lexical.search_bm25(q, i, 4, "exact").collect())
    want = shown(index.build(index.chunk_documents(odd, 8, 3)))
    made = []
    monkeypatch.setattr(index, "chunk_documents", lambda *a, **k: made.append(a))
    assert shown(index.build_documents(odd, 8, 3)) == want and len(want) == 4 and not made


def test_an_exact_search_writes_bags_of_its_own_terms(spark, odd):
    q = ask(spark, "alpha gamma", " ".join(f"w{i}" for i in range(80)))  # more terms than a scan's filter takes
    shown = lambda i: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in lexical.search_bm25(q, i, 4, "exact").collect())
    whole, built, widened = (index.build_documents(odd, 8, 3) for _ in range(3))
    lengths = {r["chunk_id"]: r["length"] for r in whole.bags.collect()}
    assert shown(whole) == shown(built) and not whole._narrow and "bags" not in built.__dict__
    (narrow,) = [rows.collect() for rows in built._narrow.values()]
    assert {r["chunk_id"]: r["length"] for r in narrow} == lengths and {t for r in narrow for t in r["terms"]} == {"alpha", "gamma", *(f"w{i}" for i in range(37))}
    assert {r["term"] for r in built.terms.collect()} == {r["term"] for r in whole.terms.collect()}  # of all, though narrow bags are there
    assert feedback.search_with_feedback(q, widened, 2, scoring="bm25", mode="exact").hits.count() and not widened._narrow


def test_passages_are_found_wherever_they_stand(spark, odd):
    q = ask(spark, "three four five", "wo three f", "one of\xa0them it's", "beta", "no such words here", "w3  w4  w5")
    want = {tuple(r) for r in odd.join(q.withColumnRenamed("text", "p"), F.contains("text", "p")).select("query_id", "document_id").collect()}
    assert {tuple(r) for r in evaluation.holders(q, odd).collect()} == want and {i for i, _ in want} >= {0, 1, 3}


def test_short_passages_are_relevant_too(spark, tmp_path):
    from quarry.plans import registry

    spark.createDataFrame([(1, "a short passage"), (2, "nowhere at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "here is a short passage.", "en", "s"), (8, "here is none", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in registry.relevant(spark, str(tmp_path)).collect()] == [(1, "7")]


def test_rank_positions_scan_texts_by_few_rows_and_write_no_whole_bags(spark, tmp_path, monkeypatch):
    from quarry.plans import registry

    spark.createDataFrame([(1, "a short passage"), (2, "nowhere at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "here is a short passage.", "en", "s"), (8, "passage passage here", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    name, made = "spark.sql.parquet.columnarReaderBatchSize", {}
    was = spark.conf.get(name)
    for module in (registry, index):
        monkeypatch.setattr(module, "written", lambda df, label, *a, keep=module.written: made.update({label: spark.conf.get(name)}) or keep(df, label, *a))
    assert tuple(registry.rank_positions(spark, str(tmp_path)).first()) == (1, 0, 0, 0, 0)
    assert made["narrow_bags"] == made["relevant"] == "256" and "bags" not in made and spark.conf.get(name) == was


def test_norms_are_made_where_a_bag_is(spark, odd, monkeypatch):
    built = index.build_documents(odd, 8, 3)
    want = {r["chunk_id"]: r["norm"] for r in index.norms_of(built.counted, built.terms, built.figures).collect()}
    monkeypatch.setattr(index, "norms_of", None)
    assert {r["chunk_id"]: r["norm"] for r in built.norms.collect()} == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(index, "HELD_TERMS", 0)
    assert index.norm_by(built.terms, 9) is None


def test_feedback_reads_all_bags_once(spark, odd, monkeypatch):
    made = []
    keep = lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, label, *a: made.append(label) or keep(df, label, *a))
    want = spark.createDataFrame([(0, "3-00000")], "query_id long, chunk_id string")
    assert {r["term"] for r in lexical.by_chunk(index.build_documents(odd, 8, 3), want).collect()} >= {"alpha", "gamma"} and made == ["feedback_bags"]


def test_only_the_documents_of_hits_are_cut(spark, tmp_path):
    from quarry.plans import registry

    spark.createDataFrame([(i, f"text {i} " * 400, "en", "s") for i in range(4)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    every = {r["chunk_id"]: r["text"] for r in index.chunk_documents(registry.documents(spark, str(tmp_path))).collect()}
    hits = spark.createDataFrame([(1, "2-00001", "2"), (2, "2-00001", "2"), (2, "0-00000", "0")], "query_id long, chunk_id string, document_id string")
    got = registry._texts(spark, str(tmp_path), hits).collect()
    assert {r["chunk_id"]: r["text"] for r in got} == {c: every[c] for c in ("2-00001", "0-00000")} and len(got) == 2
    assert not any(str(tmp_path) in key and "chunks" in key for key in registry._made)
