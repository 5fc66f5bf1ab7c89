import gzip
import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from vellum.operators import measures
from vellum import storage
from vellum.sources import files, latex, reports

TEX = r"""\documentclass{article}
% a comment
\begin{document}
\begin{abstract}We study things. They are many.\end{abstract}
\section{Introduction}\label{sec:intro}
Unlike prior methods \cite{a}, ours is fast. It follows \citep[see][]{b,c}. As Section~\ref{sec:method} shows. 50\% more.
\section*{Method}\label{sec:method}
See Table~\ref{tab:x} and $x+1$. It is in \ref{app:more} too. \iffalse hidden \ref{fig:y} \fi
\begin{table}\caption{Numbers}\label{tab:x}\begin{tabular}{ll}\hline a & b \\ 1 & 2.5 \\ 3 & 4\% \\ \hline\end{tabular}\end{table}
\begin{figure}\caption{Overview of {all}}\label{fig:y}\end{figure}
\section{Ethics Statement}
None.
\appendix
\section{More}\label{app:more}
\end{document}
"""


def test_latex_tables(spark):
    papers = spark.createDataFrame([(1, TEX), (2, None)], "doc_id long, tex string")
    found = latex.sections(papers).cache()
    assert [(r.sec, r.title, r.kind) for r in found.orderBy("sec").collect()] == [(0, "Abstract", "abstract"), (1, "Introduction", "body"), (2, "Method", "body")]
    assert {(r.sec, r.number) for r in latex.numbers(found).collect()} == {(0, None), (1, "1"), (2, None)}
    assert {(r.sec, r.role) for r in latex.roles(found).collect()} == {(1, "intro")}
    sents = latex.sentences(found).orderBy("sec", "sent").collect()
    assert [s.text for s in sents if s.sec == 1] == ["Unlike prior methods [cite], ours is fast.", "It follows [cite].", "As Section [ref] shows.", "50% more."]
    assert [s.cites for s in sents if s.sec == 1][:2] == [[["a"]], [["b", "c"]]]
    things = latex.objects(found)
    assert {(r.id, r.kind, r.home) for r in things.collect()} == {("sec:1", "section", 1), ("sec:2", "section", 2), ("tab:x", "table", 2), ("fig:y", "figure", 2)}
    points = latex.pointers(papers, found, things)
    assert {(r.src, r.target) for r in points.collect()} == {(1, "sec:2"), (2, "tab:x"), (2, "appendix:app:more")}
    assert [(r.data_rows, r.numeric_cells) for r in latex.tables(found).collect()] == [(2, 4)]
    references = measures.object_references(found, things, points)
    assert {(r.id, tuple(r.sources), r.own) for r in references.collect()} == {("sec:1", (), 0), ("sec:2", (1,), 0), ("tab:x", (), 1), ("fig:y", (), 0)}
    gap = measures.evidence_gap(papers.select("doc_id", F.lit(False).alias("acknowledged")), latex.tables(found), latex.exhibits(found))
    assert {(r.doc_id, r.score) for r in gap.collect()} == {(1, 1.0), (2, None)}


def test_digits_at_the_ends_of_keys(spark):
    """A key's place in its group takes nothing from it."""
    papers = spark.createDataFrame([(1, "\\begin{document}\\section{A}\\label{s0}Text \\cite{0a0, 1b1,k2}. See \\ref{s0,s1}. \\section{B}\\label{s1}")], "doc_id long, tex string")
    found = latex.sections(papers)
    assert [s.cites for s in latex.sentences(found).orderBy("sent").collect()] == [[["0a0", "1b1", "k2"]], []]
    assert [r.target for r in latex.pointers(papers, found, latex.objects(found)).orderBy("pos").collect()] == ["sec:1", "sec:2"]


def test_bibliography(spark):
    bib = "@article{a,\n title={GraphNet: a study},\n author={Doe, Jane and Roe, R.},\n}\n@book{b,\n title={Plain words},\n}\n"
    got = latex.work_names(spark.createDataFrame([(1, bib)], "doc_id long, bib string"))
    assert {(r.cite_key, r.name) for r in got.collect()} == {("a", "GraphNet"), ("a", "Doe et al")}


def test_files(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("src/other.tex", "\\documentclass{a}\\begin{document}\\end{document}")
        f.writestr("src/main.tex", TEX)
        f.writestr("../evil.tex", "x")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        info = tarfile.TarInfo("a/b.tex")
        info.size = 3
        f.addfile(info, io.BytesIO(b"abc"))
    parts = {"a.zip": z.getvalue(), "b.tar": t.getvalue(), "c.tar.gz": gzip.compress(t.getvalue()), "d.pdf": b"%PDF-1.5", "e.tex": b"hello", "f.bin": b"\0\1", "g.zip": b"PKbroken"}
    for name, data in parts.items():
        (tmp_path / name).write_bytes(data)
    read = files.read_files(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in read.select("path", files.kind_of(F.col("content"), F.col("path")).alias("kind")).collect()}
    assert kinds == {"a.zip": "zip", "b.tar": "tar", "c.tar.gz": "gzip", "d.pdf": "pdf", "e.tex": "tex", "f.bin": "unknown", "g.zip": "zip"}
    members = files.unpack(read).cache()
    got = {(r.archive.rsplit("/", 1)[1], r.path) for r in members.collect()}
    assert {("a.zip", "src/main.tex"), ("b.tar", "a/b.tex"), ("c.tar.gz", "a/b.tex"), ("g.zip", None)} <= got and not any(p and "evil" in p for _, p in got)
    assert [r.path for r in files.main_tex(members).collect()] == ["src/main.tex"]
    assert {(r.archive.rsplit("/", 1)[1], r.kind, r.path) for r in files.paper_source(members).collect()} >= {("a.zip", "tex", "src/main.tex"), ("d.pdf", "pdf", "d.pdf"), ("f.bin", "unknown", None)}
    kinds = spark.createDataFrame([("https://arxiv.org/abs/2401.12345v2",), ("https://openreview.net/forum?id=Ab-1",), ("http://x.y/z.PDF?a",), ("http://x.y",)], ["u"]).select(files.address_kind(F.col("u")))
    assert [r[0] for r in kinds.collect()] == ["arxiv:2401.12345", "openreview:Ab-1", "pdf", "page"]


def test_reports(spark, tmp_path):
    measure = {"key": "cross_refs", "plane": "structure", "status": "done", "score": 0.81818, "num": 9, "den": 11, "notes": ["a", "b"], "instances": [{"text": "t1", "section_title": "§1", "pdf": [{"p": 0, "r": [[1.0, 2.0, 3.0, 4.0]]}, {"p": 2, "r": []}]}, {"text": "t2"}]}
    empty = {"key": "evidence_gap", "plane": "artifacts", "status": "na", "notes": ["n1", "n2"], "instances": []}
    job = {"key": "k1", "status": "done", "gallery": True, "created": 5.0, "label": "L", "result": {"index": {"index": 66, "partial": True}, "document": {"title": "T", "url": "https://www.example.org/x"}, "measures": [measure, empty]}}
    for key, value in (("k1", json.dumps(job)), ("k2", json.dumps({**job, "key": "k2", "status": "error"})), ("k3", "{broken")):
        (tmp_path / key).mkdir()
        (tmp_path / key / "job.json").write_text(value)
    read = reports.read_reports(spark, str(tmp_path)).cache()
    assert [r["key"] for r in read.collect()] == ["k1"]
    shown = reports.gallery(read).first()
    assert (shown["index"], shown["partial"], shown["source"], shown["planes"]) == (66, True, "Example", {"structure": 0.81818, "artifacts": None})
    rows = {(r.measure, r.finding, r.pdf_pages) for r in reports.findings(reports.measure_results(read)).collect()}
    assert rows == {("cross_refs", "t1", "1 3"), ("cross_refs", "t2", ""), ("evidence_gap", "n1; n2", "")}
    assert [(r.measure, r.note) for r in reports.first_page_marks(reports.measure_results(read)).collect()] == [("cross_refs", "t1")]
    both = reports.first_of(read.select("key", F.lit("mem").alias("at")), spark.createDataFrame([("k1", "disk"), ("k9", "disk")], ["key", "at"]))
    assert {(r["key"], r["at"]) for r in both.collect()} == {("k1", "mem"), ("k9", "disk")}


def test_runs(spark, tmp_path):
    run = {"meta": {"item": "1-1", "pre": {"FAIL": 1, "PASS": 0, "UNRESOLVED": 2}}, "units": [{"id": "a", "runs": ["PASS"], "final": "PASS"}, {"id": "b", "final": "FAIL"}, {"id": "c", "final": "NOT_APPLICABLE"}]}
    (tmp_path / "1-1.json").write_text(json.dumps(run))
    got = reports.run_scores(*reports.read_runs(spark, str(tmp_path))).first()
    assert (got.f, got.p, got.u, got.score, got.coverage) == (2, 1, 2, 2 / 3, 3 / 5)


def test_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("analysis", "2025-01-01 00:00:00", "k", "secret"), ("vote", "2025-01-01 00:00:00", "k", "x")], "kind string, at string, key string, _token string")
    reports.append_log(rows, f"{tmp_path}/log")
    reports.append_log(rows, f"{tmp_path}/log")
    assert reports.read_log(spark, f"{tmp_path}/log", "analysis").count() == 2
    assert "_token" not in spark.read.json(f"{tmp_path}/log").columns
    reports.write_csv(rows.drop("_token"), f"{tmp_path}/csv")
    assert reports.read_sheet(spark, f"{tmp_path}/csv", "vote").count() == 1


def test_main_source_and_paper(spark):
    tex = "\\documentclass{a}\\begin{document}caf\u00e9"
    rows = [("x", "a.tex", tex.encode("latin-1")), ("x", "Main.TEX", tex.encode()), ("y", "hidden.tex", b"% \\documentclass{a}\n% \\begin{document}"), ("y", "s.pdf", b"%PDF"), ("y", "l.pdf", b"%PDF-1.5"), ("z", "n.tex", tex.encode("latin-1")), ("w", None, None)]
    members = spark.createDataFrame([(a, p, None if c is None else bytearray(c)) for a, p, c in rows], "archive string, path string, content binary")
    assert {(r.archive, r.path, r.text) for r in files.main_tex(members).collect()} == {("x", "Main.TEX", tex), ("z", "n.tex", tex)}
    assert {tuple(r) for r in files.paper_source(members).collect()} == {("x", "tex", "Main.TEX"), ("y", "pdf", "l.pdf"), ("z", "tex", "n.tex"), ("w", "unknown", None)}
    titles = spark.createDataFrame([(1, "Deep nets in 2024"), (2, "")], "doc_id long, title string")
    pdfs = spark.createDataFrame([(1, "b", 4, "deep nets"), (1, "a", 9, "DEEP NETS"), (1, "c", 3, "deep nets"), (1, "d", 5, "deep"), (2, "e", 8, "x")], "doc_id long, path string, pages int, text string")
    assert [tuple(r) for r in files.paper_pdf(titles, pdfs).collect()] == [(1, "a")]


def test_views_without_helper_columns(spark, tmp_path):
    reports.write_views({"v": spark.createDataFrame([(1, 2)], "a int, _b int")}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/v").columns == ["a"]


def test_mirror(spark, tmp_path):
    rows = [{"key": k, "status": "done", "gallery": shown, "label": f"L{k}", "result": {"index": {"index": 5}, "document": {"title": None}, "measures": [{"key": "cross_refs", "plane": "structure", "status": "done", "score": 0.5, "notes": ["n"]}]}} for k, shown in (("k1", True), ("k2", False), ("k3", True), (None, True))]
    read = spark.read.schema(reports.REPORT).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    log = spark.createDataFrame([("2024-01-02 x",), (None,)], "at string")
    for _ in range(2):
        reports.write_mirror(read, log, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "jobs").glob("of=*")) == ["of=k1", "of=k3"]
    assert spark.read.schema(reports.REPORT).json(f"{tmp_path}/jobs/of=k1").select("key", "label", "result.index.index").collect() == [("k1", "Lk1", 5)]
    assert spark.read.json(f"{tmp_path}/stats").select("analyses", "since").first() == (2, "2024-01-02")
    assert {r.title for r in spark.read.json(f"{tmp_path}/gallery").collect()} == {"Lk1", "Lk3"} and spark.read.json(f"{tmp_path}/findings").count() == 2


def test_comments(spark):
    texts = ["a\\begin{comment}x\ny\\end{comment}b", "a % x\n  % gone\n50\\% b\\\\% c", "a\\iffalse x\n% \\fi\ny\\fi b", "a\n% end"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(latex.without_comments(F.col("t")).alias("t"))
    assert [r.t for r in frame.collect()] == ["ab", "a \n50\\% b\\\\", "a b", "a\n"]


def test_sections_number_within_rows(spark):
    tex = "\\documentclass{x}\n\\begin{document}\\begin{abstract}A.\\end{abstract}\n\\section{One}\\sectionmark{o}a\\\\\\\\% b\n\\section*{Ethics}e\n\\section [s]{Two {x}}t\\% u\n\\begin{ack}no\\section{No}\\end{document}\n\\section{Out}"
    plain = spark.createDataFrame([(1, tex), (2, tex.replace("a\\", "\0a\\")), (3, "\\section{Only}o\\printbibliography"), (4, None), (5, "none")], "doc_id long, tex string")
    found = latex.sections(plain)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # texts were shuffled and sorted before
    got = [tuple(r) for r in found.orderBy("doc_id", "sec").collect()]
    of = lambda i, mark: [(i, 0, "Abstract", False, "abstract", "A."), (i, 1, "One", False, "body", f"\\sectionmark{{o}}{mark}a\\\\\\\\\n"), (i, 2, "Two {x}", False, "body", "t\\% u\n")]
    assert got == [*of(1, ""), *of(2, "\0"), (3, 1, "Only", False, "body", "o")]


def test_large_sides_are_not_broadcast_by_their_files(spark):
    rows = storage.kept(spark.range(50_000).select("id", F.lit("a").alias("same")), "rows")
    plan = lambda limit: rows.join(storage.small_side(rows, limit), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(None)
    assert "Broadcast" not in plan(1000)  # the files are far below Spark's threshold, by which the driver gathered the rows before


def test_quotations_are_looked_for_where_marks_stand(spark):
    said = "``" + "a word " * 20 + "''"
    texts = [said, said.replace("``", "“").replace("''", "”"), said.replace("``", "`\\emph `"), "a word " * 40]
    found = spark.createDataFrame([(i, 1, "T", False, "body", t) for i, t in enumerate(texts)], "doc_id long, sec int, title string, starred boolean, kind string, raw string")
    got = latex.exhibits(found)
    assert sorted(tuple(r) for r in got.collect()) == [(0, "quotation"), (1, "quotation"), (2, "quotation")]
    assert "Contains(raw" in got._jdf.queryExecution().optimizedPlan().toString()  # all sections were made prose before
