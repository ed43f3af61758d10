import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, load, save
from lodestone.functions import prompts
from lodestone.functions import text as T
from lodestone.functions.errors import Refused, classify
from lodestone.operators import ann, chunking, documents, evaluation, graph, keyword, models, shared
from lodestone.operators import retrieval as R
from lodestone.sources import files


def one(spark, expression, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'int' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
    return df.select(expression(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    ("text", "n"),
    [("It costs 4.50 today. Tomorrow it is 5.25 or so.", 2), ("As eq. 7 of vol. 2 has it, all is well.", 1), ("J. K. Winter and P. Lane went home.", 1), ("Who goes there?! Nobody at all!", 2), ("So... we left. Then", 3), (" \n ", 0)],
)
def test_sentences(spark, text, n):
    assert len(one(spark, T.sentences, text)) == n == len(chunking.simple_sentences(text))


def test_claims_and_verdicts(spark):
    assert one(spark, T.claims, "Rain fell on 2.5 days. On the third\nit was dry. ok") == ["Rain fell on 2.5 days.", "On the third", "it was dry."]
    for reply, want in (("4", 4), ("none of them", 0), ("I would say 3, perhaps 1", 3), ("17", 0), ("", 0), ("0", 0)):
        assert one(spark, T.verdict, reply, 4) == want
    assert one(spark, T.rerank_order, "best: 4 then 2 then 9", 9) == [3, 1, 8]
    assert one(spark, T.rerank_order, "2 2 0 41 3", 4) == [1, 2]
    assert one(spark, T.delete_spec, "4, 12-10,4") == [4, 10, 11, 12] and one(spark, T.delete_spec, "4;5") is None
    assert one(spark, T.is_factual, "The bridge opened in May.") and not one(spark, T.is_factual, "Is it not open yet, then?") and not one(spark, T.is_factual, "Unfortunately there is nothing.")


def test_query_building(spark):
    assert one(spark, T.fts_query, "where are the lighthouses") == '"lighthouses"' and one(spark, T.fts_query, "who was it?") == ""
    assert one(spark, T.fts_query, 'Which Harbour "closed"?') == '"Harbour" OR """closed""?"'
    assert one(spark, T.needs_decomposition, "Tides versus winds") and not one(spark, T.needs_decomposition, "Where do tides come from?")
    assert one(spark, T.context_window, "") == 4096 and one(spark, T.context_window, "x" * 200_000) == 32768 and one(spark, T.context_window, "x" * 12_000) == 5024
    assert one(spark, T.query_flags, "  when --date  did it --source open ").asDict() == {"question": "when did it open", "date": True, "source": True}
    assert one(spark, T.lookups, "LOOKUPS:\n- harbour dues\n2) tide tables\nno:\nab") == ["harbour dues", "tide tables"]


def test_identity_and_names(spark):
    assert one(spark, T.doc_key, "typed", "", 3) == "chunk:3" and one(spark, T.doc_key, "/x/y.org", "", 3) == "/x/y.org" and one(spark, T.doc_key, "A page", "https://h.net/p", 3) == "https://h.net/p"
    assert one(spark, T.content_type, "q/M.RS") == "code:rust" and one(spark, T.content_type, "z.md") == "markdown" and one(spark, T.content_type, "none") == "text"
    assert one(spark, T.strip_html, "<b>x &amp;gt; y</b>&nbsp;&quot;") == 'x > y "'
    assert one(spark, T.graph_label, "text", "A page", "https://h.net:8080/p") == "A page" and one(spark, T.graph_label, "text", "http", "https://h.net:8080/p") == "h.net:8080"
    assert one(spark, T.graph_label, "text", "/a/b/c.txt", "") == "b/c.txt" and one(spark, T.graph_label, "n" * 51, "typed", "") == "n" * 50 + "..."
    assert one(spark, T.safe_name, " a/b\\c ") == "a-b-c" and one(spark, T.safe_name, "") == "untitled" and one(spark, T.doc_title, "/a/b.txt", "") == "b.txt"
    assert one(spark, T.stub, "a note of some length é", "typed", "")["name"] == "a note of some lengt.txt"


def test_sections_and_chunks(spark):
    text = "# Boats\nwood\n### Keels\nlead\n## Sails\n```\n# no heading\n```\n# Ports\n## Quays ##\nstone"
    assert [h for h, _ in chunking.sections(text)] == ["Boats", "Boats >  > Keels", "Boats > Sails", "Ports > Quays"]
    rows = [(1, "# Tides\n## Spring\nHigh water.", "markdown"), (2, None, "text"), (3, "", "text"), (4, "x" * 500_001, "text"), (5, "w " * 900, "text")]
    got = chunking.chunk(spark.createDataFrame(rows, "id long, text string, content_type string")).collect()
    by = {i: [r for r in got if r["id"] == i] for i in range(1, 6)}
    assert by[1][0]["text"] == "Tides > Spring: High water." and by[1][0]["heading_path"] == "Tides > Spring"
    assert by[2][0]["error"] and by[2][0]["text"] is None and not by[3] and by[4][0]["error"] and [r["chunk_index"] for r in by[5]] == [0, 1, 2]
    chunks = chunking.pack([f"word{i} " * 90 + "end." for i in range(12)])
    assert len(chunks) > 1 and all(len(c.split()) <= 500 for c in chunks) and chunks[1].split()[0] == chunks[0].split()[-91]
    code = "\n".join(f"def f{i}():\n    return {i}" for i in range(100))
    assert all(c.startswith("def") for c in chunking.code_chunks(code))
    assert [chunking.top_level(x) for x in ("a = 1", "", "  b", "\tc", "}", "};", "# d")] == [True, False, False, False, False, False, True]


def test_stitching():
    assert chunking.stitch(["we met on Monday and left", "on Monday"]) == "we met on Monday and left\n\non Monday"
    assert chunking.stitch(["The tide rose. Then it fell.", "Then it fell. At last it was calm."]) == "The tide rose. Then it fell. At last it was calm."
    assert chunking.stitch(["one", "two"]) == "one\n\ntwo" and chunking.stitch([]) == "" and chunking.stitch(["abc", "bc", "cd"]) == "abc d"
    assert chunking.stitch(["x", "", "é x", "x é"]) == "x\n\né x é"
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("ab "), rng.integers(0, 9))).encode() for _ in "ab")
        assert chunking.overlap(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a.endswith(b[:k]) or k == 0)


def test_files(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:p><w:r><w:t>One of the lines</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:document>')
    made = {
        "a.docx": data.getvalue(), "b.docx": b"no zip, but of some length", "c.txt": "Grüße an alle, die hier lesen".encode("latin-1"), "d.txt": b"total 10\nabc of it all...\x00binary",
        "e.txt": b"a tab after 11\tand then 0 \x10 more", "f.pdf": b"%PDF-1.4 something long enough", "g.md": b"# Head\nsome *bold* `code` and so on", "h.txt": b"short", "i.exe": b"not a kind that is read at all",
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.docx"]["text"] == "One of the lines\ttwo\nThree" and got["b.docx"]["text"] == "" and "i.exe" not in got
    assert got["c.txt"]["text"].startswith("Gr�") and got["d.txt"]["text"] == "" and got["e.txt"]["text"].startswith("a tab") and got["h.txt"]["text"] == ""
    assert got["f.pdf"]["error"] and got["f.pdf"]["text"] == "" and got["g.md"]["text"] == "# Head\nsome bold code and so on" and got["g.md"]["error"] is None
    read = files.extract(files.read_files(spark, str(tmp_path)), pdf=lambda content: F.lit("text of a file\r\nin two lines")).where("path LIKE '%.pdf'").first()
    assert read["text"] == "text of a file\nin two lines" and read["error"] is None


def test_fusion_and_graph(spark):
    lists = spark.createDataFrame([(0, 0, 1, 7, 0.1), (0, 0, 2, 8, 0.2), (0, 1, 1, 9, 0.0), (0, 1, 2, 8, 0.0)], "query_id long, list_no int, rank int, id long, distance double")
    got = R.rrf(lists, 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [8, 7, 9] and got[0]["distance"] == 0.2 and got[2]["distance"] == 0.0
    chain = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.2), ("c", "a", 0.3), ("c", "d", 0.3)], "a string, b string, distance double")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "doc_key string")
    found, inside = graph.neighbourhood(nodes, chain, "a", 1)
    assert {r["doc_key"]: r["depth"] for r in found.collect()} == {"a": 0, "b": 1, "c": 1} and inside.count() == 3
    assert {r["node"]: r["depth"] for r in graph.walk(chain, "a", 2).collect()}["d"] == 2 and graph.walk(chain, "a", -1).count() == 1
    with pytest.raises(LookupError):
        graph.neighbourhood(nodes, chain, "zz", 1)
    assert [r["neighbour"] for r in graph.neighbours_of(chain, "c").collect()] == ["b", "a", "d"]


def test_nearest_against_plain_search(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((40, 8)).astype(np.float32)
    v[5] = v[6] = v[7]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>")
    d = 1 - v.astype(np.float64) @ v.T.astype(np.float64)
    for which, ok in (("any", lambda i, j: True), ("other", lambda i, j: i != j), ("earlier", lambda i, j: j < i)):
        got = {(r["query_id"], r["rank"]): r["id"] for r in R.nearest(df.withColumnRenamed("id", "query_id"), df, 3, 1.1, which).collect()}
        want = {(i, k + 1): j for i in range(40) for k, j in enumerate(sorted((j for j in range(40) if ok(i, j) and d[i, j] < 1.1), key=lambda j: (round(d[i, j], 12), j))[:3])}
        assert got == want, which
    pairs = {(r["source_id"], r["target_id"]) for r in R.neighbours(df, 0.5).collect()}
    assert pairs == {(i, j) for i in range(40) for j in range(40) if i != j and d[i, j] < 0.5}


def test_nearest_copies_no_vector(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    df = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(60)], "id long, embedding array<float>")
    for found in (R.nearest(df.withColumnRenamed("id", "query_id"), df, 3), R.edges(df, 3.0, 3, "earlier"), R.neighbours(df, 3.0)):
        plan = found._jdf.queryExecution().toString()
        assert "CoGroup" not in plan and "explode" not in plan and "embedding" not in plan


def test_delete_cascade_makes_no_list_of_all_pairs(spark, monkeypatch):
    from lodestone.plans import catalogue

    def refuse(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(R, "neighbours", refuse)
    assert catalogue.delete_cascade(spark, "/root/testdata/sf0.001").groupBy("source_id").count().where("count > 8").isEmpty()


def test_leaders_against_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 30)
    monkeypatch.setattr(R, "ROUND", 64)
    monkeypatch.setattr(R, "DECIDED", 40)
    v = np.random.default_rng(4).standard_normal((300, 4)).astype(np.float32)
    v[200:260] = v[40]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i * 3, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>").repartition(3)
    for threshold in (0.01, 0.6):
        want = []
        for i in range(300):
            if not (R.exact(np.broadcast_to(v[i], (len(want), 4)), v[want]) < threshold).any():
                want.append(i)
        assert sorted(r["id"] // 3 for r in R.leaders(df, threshold).collect()) == want, threshold
    assert R.leaders(df.limit(0), 0.1).count() == 0


def test_notes_list_no_pairs(spark, tmp_path, monkeypatch):
    from lodestone.knowledge import KnowledgeBase

    def refuse(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(R, "neighbours", refuse)
    rows = spark.createDataFrame([("Remember to oil the hinges of the boathouse door.", "typed", "", i) for i in range(50)], "text string, source string, origin string, seq long")
    got = KnowledgeBase(spark, str(tmp_path / "kb")).add(rows).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in got} == {"saved": 1, "too similar": 49}


def test_ordinals_of_one_large_key(spark):
    df = spark.range(500).selectExpr("id", "'one' as k", "pmod(hash(id), 97) as o")
    got = [r["ordinal"] for r in shared.ordinals(df, ["k"], ["o", "id"], start=5).orderBy("o", "id").collect()]
    assert got == list(range(5, 505))


def test_ordinals_move_rows_once(spark):
    df = spark.range(50).selectExpr("id", "repeat('x', 9) as text")
    got = shared.ordinals(df, [], ["id"])
    assert "__range" not in "".join(x for x in got._jdf.queryExecution().toString().splitlines() if "Window" in x and "text" in x)
    assert "row_number" not in got._jdf.queryExecution().toString() and [r["ordinal"] for r in got.orderBy("id").collect()] == list(range(50))


def test_chunks_come_a_few_documents_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(chunking, "STEP", 2)
    df = spark.createDataFrame([(i, f"# H{i}\nOne line.", "markdown", f"k{i}") for i in range(7)], "id long, text string, content_type string, key string")
    got = chunking.chunk(df, carry=("key", "content_type")).orderBy("id").collect()
    assert [(r["id"], r["heading_path"], r["text"], r["key"], r["content_type"]) for r in got] == [(i, f"H{i}", f"H{i}: One line.", f"k{i}", "markdown") for i in range(7)]


def test_refused_texts_stay_in_the_jvm(spark, monkeypatch):
    rows = [(1, "x" * 500_001, "text"), (2, None, "markdown"), (3, "One. Two.", "text"), (4, "\u00e9" * 250_001, "markdown"), (5, "plain", None)]
    df, real, sent = spark.createDataFrame(rows, "id long, text string, content_type string"), type(spark.range(1)).mapInArrow, []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, *a, **b: sent.append(self) or real(self, *a, **b))
    got = {r["id"]: (r["text"], r["error"]) for r in chunking.chunk(df).collect()}
    assert got == {1: (None, "over 500000 bytes"), 2: (None, "no text"), 3: ("One. Two.", None), 4: (None, "over 500000 bytes"), 5: ("plain", None)}
    assert sum(len(x) for r in sent[0].collect() for x in r if isinstance(x, str)) < 200


def test_prose_by_the_rule_of_its_sql(spark, tmp_path):
    import duckdb

    from lodestone.plans import catalogue

    rng, bits = np.random.default_rng(3), ["a", "e.g", "E.G", "Dr", "approx", "x1", "\u017ft", "\u212a", "no", ".", "!", "?", "..", ".?", " ", "  ", "\n", "\t", "\r", "\x01", "\x02", "\xa0", "\u3000", "\x85", "\u00e9", "word"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(0, 16))), "en", "s", 1) for i in range(2000)] + [(2000, "Sir. " * 900 + "?" * 20_000 + "x. Dr. Who", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalogue.chunk_prose(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT id, chunk_index, text FROM ({catalogue.ORACLES['chunk_prose']})").fetchall()
    assert sorted(map(tuple, made.select("id", "chunk_index", "text").collect())) == sorted(want)
    assert "regexp" not in made._jdf.queryExecution().toString()  # sentences are cut where they are packed


def test_cases_are_worked_out_once(spark):
    from lodestone.plans import catalogue

    held = catalogue.cases(spark, "/root/testdata/sf0.001")[1]
    assert "Join" not in held._jdf.queryExecution().toString() and held.columns == ["query_id", "relevant"]


def test_saving_an_index_makes_postings_once(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("sampled for ranges")

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", refuse)
    keyword.build(spark.createDataFrame([(1, "keels of oak"), (2, "an oak keel")], "id long, text string")).save(f"{tmp_path}/index")
    found = keyword.bm25(keyword.Index.load(spark, f"{tmp_path}/index"), spark.createDataFrame([(7, "keel")], "query_id long, text string"), 5)
    assert {r["id"] for r in found.collect()} == {1, 2}


def test_greedy_near_dups_keeps_the_end_of_a_chain(spark):
    pairs = spark.createDataFrame([(2, 1), (1, 2), (3, 2), (2, 3)], "source_id long, target_id long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {r["id"]: r["kept"] for r in R.greedy_near_dups(pairs, ids).collect()} == {1: True, 2: False, 3: True}


def test_keyword_search_against_fts5(spark):
    """Stems, marks, phrases, repeated words and weights, as SQLite's full-text search has them."""
    import sqlite3

    texts = ["The naïve sailors were sailing past ZBQ-7788 lighthouses.", "A sail, naive and torn; zbq 7788", "Connected connections connect ships", "7788 zbq ships & ships", "", "Running runners ran in the harbour of São Paulo", "ponies and a pony ran", "nothing of that kind"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(texts, 1))
    docs = spark.createDataFrame([*enumerate(texts, 1)], "id long, text string")
    asked = ["ZBQ-7788", "sailing", "naive", "connection ships ships", "Sao harbours", "pony & running", "zebra"]
    index = keyword.build(docs)
    got = keyword.bm25(index, spark.createDataFrame([*enumerate(asked)], "query_id long, text string"), 10).collect()
    for i, q in enumerate(asked):
        phrases = " OR ".join('"' + w.replace('"', '""') + '"' for w in q.split())
        want = {r: round(-s, 6) for r, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (phrases,))}
        mine = {r["id"]: r["score"] for r in got if r["query_id"] == i}
        assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 2e-6 for k in want), q
    left = index.without(spark.createDataFrame([(2,)], "id long")).plus(spark.createDataFrame([(9, "one more sail")], "id long, text string"))
    assert {r["id"] for r in keyword.bm25(left, spark.createDataFrame([(0, "sail")], "query_id long, text string"), 5).collect()} == {1, 9}


def test_evaluation(spark, tmp_path):
    results = spark.createDataFrame([(0, 1, "a"), (1, 3, "b"), (2, 1, "c"), (2, 2, "c"), (3, 1, "x")], "query_id long, rank int, source string")
    cases = spark.createDataFrame([(0, ["a"], 1), (1, ["b"], 2), (2, ["c", "d"], 0), (3, ["e"], 2)], "query_id long, relevant array<string>, hops int")
    rows = evaluation.evaluate(results, cases)
    got = {r["query_id"]: r for r in rows.collect()}
    assert (got[0]["recall_1"], got[1]["recall_1"], got[1]["recall_3"], got[2]["recall_3"]) == (1, 0, 1, 0.5)
    assert [r["query_id"] for r in evaluation.misses(rows).collect()] == [3]
    assert {r["slice"]: (r["cases"], r["mrr"]) for r in evaluation.by_hops(rows, cases).collect()} == {"single-hop": (2, 1.0), "multi-hop": (2, 0.166667)}
    assert evaluation.nearest_rank([5, 1, 2, 3], 50) == 2 and evaluation.nearest_rank([], 50) == 0
    assert evaluation.load_baseline(str(tmp_path / "none.json")) is None
    now = evaluation.baseline(evaluation.summarise(rows), [0.1, 0.2, 0.3], "x")
    evaluation.save_baseline(str(tmp_path / "b.json"), now | {"mrr": now["mrr"] - 0.25})
    delta = {r["metric"]: r["delta"] for r in evaluation.deltas(spark, now, evaluation.load_baseline(str(tmp_path / "b.json"))).collect()}
    assert delta["MRR"] == "+0.250" and delta["recall@1"] == "-" and {r["delta"] for r in evaluation.deltas(spark, now, None).collect()} == {"-"}
    golden = tmp_path / "golden.json"
    golden.write_text(json.dumps({"cases": [{"question": "where is it", "relevant": ["a.txt"], "hops": 2}, {"question": "and that", "relevant": ["b"]}]}))
    read = evaluation.read_golden(spark, str(golden))
    assert [(r["query_id"], r["hops"], r["note"]) for r in read.orderBy("query_id").collect()] == [(0, 2, ""), (1, 0, "")]
    asked = evaluation.run(read, lambda q, k: q.select("query_id", F.lit(1).alias("rank"), F.lit("/x/a.txt").alias("source")))
    assert {r["query_id"]: r["first_rank"] for r in asked.collect()} == {0: 1, 1: 0} and len(evaluation.time_each(read, lambda q, k: [])) == 2
    for bad in ({"cases": []}, {"cases": [{"question": " ", "relevant": ["a"]}]}, {"cases": [{"question": "q", "relevant": []}]}):
        golden.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            evaluation.read_golden(spark, str(golden))


def fail(prompts_of):
    raise ConnectionError("connection refused")


def test_models_degrade(spark):
    q = spark.createDataFrame([(0, "Tides and also winds, compare both?"), (1, "Where is it?"), (2, "  ")], "query_id long, text string")
    reply = lambda prompts: ["1. tides\n2. TIDES\n3. winds\n4. moons\n5. storms\n6. calms"] * len(prompts)
    got = [(r["query_id"], r["query_no"], r["text"]) for r in models.rewrite(q, reply).orderBy("query_id", "query_no").collect()]
    assert [g[2] for g in got if g[0] == 0] == ["Tides and also winds, compare both?", "tides", "winds", "moons", "storms"] and [g for g in got if g[0] > 0] == [(1, 0, "Where is it?")]
    assert models.rewrite(q, fail).count() == 2 and models.rewrite(q, None).count() == 2
    hits = spark.createDataFrame([(0, r, 10 + r, f"text {r}") for r in (1, 2, 3, 4)] + [(1, 1, 20, "alone")], "query_id long, rank int, id long, text string")
    order = lambda m, top: [r["id"] for r in models.rerank(q, hits, m, top).where("query_id = 0").orderBy("rank").collect()]
    assert order(lambda p: ["4, 2"] * len(p), 3) == [14, 12, 11] and order(fail, 2) == [11, 12] and order(lambda p: ["no idea"] * len(p), 9) == [11, 12, 13, 14]
    answer = spark.createDataFrame([(0, "The bridge opened in May. It is not mentioned anywhere. Was it closed again later? " + "The mast is made of oak wood. " * 25)], "query_id long, text string")
    passages = spark.createDataFrame([(0, 1, "a mast of oak")], "query_id long, rank int, text string")
    claims = models.verify(answer, passages, lambda p: ["1" if "mast" in x.rsplit("claim:", 1)[1] else "NONE" for x in p])
    assert [r["support"] for r in claims.orderBy("claim_no").collect()][:4] == ["unsupported", "not-checked", "not-checked", "supported"] and claims.count() == 20
    report = models.grounded(claims).first()
    assert (report["checked"], report["supported"]) == (18, 17) and "94% (17/18" in report["report"] and "not in your documents: The bridge opened in May." in report["report"]
    none = models.grounded(models.verify(answer, passages, fail)).first()
    assert (none["checked"], none["groundedness"], none["report"]) == (0, 0.0, "")
    zero = models.embed(q, lambda texts: np.zeros((len(texts), 4))).select("embedding").first()[0]
    assert zero == [0.0] * 4


def test_prompts(spark):
    p = [("Some text.", "", "/a/b.txt", "", "Head > Sub"), ("Other text.", "A title", "x", "https://h.net", "")]
    rows = spark.createDataFrame([("why?", [(*x, None) for x in p])], "q string, p array<struct<text:string,doc_title:string,source:string,origin:string,heading_path:string,created_at:timestamp>>")
    text = rows.select(prompts.answer(F.col("q"), F.col("p"), F.lit(True), F.lit(False))).first()[0]
    assert "DOCUMENTS (2):\n  1. b.txt\n  2. A title" in text and "[1] document: b.txt | section: Head > Sub | saved: \nSome text." in text and "the day it was saved" in text and text.endswith("ANSWER:")
    assert "6." not in rows.select(prompts.answer(F.col("q"), F.col("p"), F.lit(False), F.lit(False))).first()[0]
    assert one(spark, lambda x: prompts.head(x, 3), "aé一b") == "aé..." and one(spark, lambda x: prompts.head(x, 9), "abc") == "abc"


def test_settings_and_errors(tmp_path):
    at = str(tmp_path / "s.json")
    assert load(at, {}) == DEFAULTS
    save(at, load(None, {"LODESTONE_TOP_K": "7", "LODESTONE_MCP_ENABLED": "true", "OTHER": "1"}))
    got = load(at, {"LODESTONE_TOP_K": "9"})
    assert got.top_k == 9 and got.mcp_enabled and load(at, {}).top_k == 7
    (tmp_path / "s.json").write_text('{"nothing_like_it": 1}')
    with pytest.raises(ValueError):
        load(at, {})
    assert [classify(e)[0] for e in (ValueError("database is locked"), OSError("dial: connection refused"), LookupError("x"), Refused("y"), ValueError("z"))] == ["index_unavailable", "embedder_unavailable", "not_found", "invalid_input", "internal_error"]


def test_graph_index(spark):
    v = ann.clustered(600, 32)
    g = ann.Graph(32)
    for i, x in enumerate(v):
        g.add(i, x)
    hits = sum(len({i for _, i in g.search(q, 10, 64)} & set(np.argsort(-(v @ q))[:10].tolist())) for q in v[:20])
    assert hits / 200 >= 0.9 and ann.Graph(3).search(np.ones(3), 5) == [] and g.search(v[0], 0) == []
    for call in (lambda: g.add(0, np.ones(3)), lambda: g.search(np.ones(3), 1)):
        with pytest.raises(ValueError):
            call()
    g.add(7, v[100] * -1)
    assert len(g) == 600 and 7 not in [i for _, i in g.search(v[7], 3)] and g.search(-v[100], 1)[0][1] == 7
    again = ann.Graph.restore(g.dump())
    assert again.search(v[3], 5) == g.search(v[3], 5) and max(len(n[0]) for n in g.links) <= 32
    with pytest.raises(ValueError):
        ann.Graph.restore(__import__("pickle").dumps({"format": 0}))
    df = ann.synthetic(spark, 900, 16, rows=200)
    q = df.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    got = ann.search(ann.build(df, 300), q, 5, block=7).select("query_id", "id")
    assert df.count() == 900 and R.nearest(q, df, 5).join(got, ["query_id", "id"]).count() / 90 >= 0.9
    swept = ann.sweep(spark, (100, 200), (10, 50), 16, 5, 5).collect()
    assert len(swept) == 4 and all(0 <= r["recall"] <= 1 and r["bytes"] > 0 for r in swept) and ann.crossover(spark.createDataFrame(swept)).count() <= 2


def test_questions_meet_a_bounded_number_of_graphs(spark):
    v = ann.clustered(500, 16)
    g, ids = ann.Graph(16), np.arange(0, 1000, 2)
    g.fill(ids, np.where(ids[:, None] % 3 == 0, v[6], v))  # every third a copy of one vector
    assert len(g) == 500 and [i for _, i in g.search(v[6], 9)] == ids[ids % 3 == 0][:9].tolist() and max(len(n[0]) for n in g.links) <= 32
    g.add(6, -v[6])
    again = ann.Graph.restore(g.dump())
    assert [i for _, i in again.search(v[6], 3)] == [0, 12, 18] and again.search(-v[6], 1)[0][1] == 6 and len(again) == 500
    again.add(1001, v[3] * -1)
    assert again.search(v[3] * -1, 1)[0][1] == 1001
    df = ann.synthetic(spark, 700, 16, rows=200)
    copies = df.unionAll(df.selectExpr("id + 1000 AS id", "embedding")).unionAll(df.selectExpr("id + 2000 AS id", "embedding"))
    index = shared.kept(ann.build(copies, 5))
    assert 32 < index.count() <= ann.GRAPHS and index.agg(F.sum("n")).first()[0] == 2100
    q = df.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    got, want = ann.search(index, q, 5, block=4), R.nearest(q, copies, 5)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))  # ties by id, distances alike


def test_documents(spark):
    rows = [(1, "one two", "/d/a.txt", "", 1), (2, "two three", "/d/a.txt", "", 2), (3, "note", "typed", "", 0), (4, "web", "Title", "https://h.net/A_b", 0)]
    c = spark.createDataFrame(rows, "id long, text string, source string, origin string, chunk_index int").withColumn("created_at", F.timestamp_seconds(F.col("id")))
    names = ["2", "chunk:3", "/d/a.txt", "A.TXT", "net/aXb", "99", "nothing", " "]
    got = {r["identifier"]: r["doc_key"] for r in documents.resolve(c, spark.createDataFrame([(n,) for n in names], "identifier string")).collect()}
    assert got == {"2": "/d/a.txt", "chunk:3": "chunk:3", "/d/a.txt": "/d/a.txt", "A.TXT": "/d/a.txt"}
    wild = documents.resolve(c, spark.createDataFrame([("net/a_b",), ("h%b",)], "identifier string")).collect()
    assert {r["doc_key"] for r in wild} == {"https://h.net/A_b"} and len(wild) == 2
    whole = documents.fetch(c, spark.createDataFrame([("/d/a.txt",), ("none",)], "doc_key string"))
    p = documents.payload(whole, None, 10).collect()
    assert len(p) == 1 and p[0]["content"] == "one two th\n\n[truncated]" and p[0]["truncated"] and p[0]["chunk_ids"] == [1, 2] and p[0]["saved_at"] == "1970-01-01T00:00:02Z"


def test_ends_of_names_in_any_case(spark):
    c = spark.createDataFrame([(1, "\u00c8lan des marins du port%% ", "https://h.net/1"), (2, "x", "https://h.net/\u00e9t\u00e9")], "id long, source string, origin string")
    got = documents.resolve(c, spark.createDataFrame([("\u00c8lan des marins du port%% ",), ("NET/\u00c9T\u00c9",)], "identifier string")).collect()
    assert {r["doc_key"] for r in got} == {"https://h.net/1", "https://h.net/\u00e9t\u00e9"}


def test_rewritten_questions_against_sql(spark, tmp_path):
    import duckdb

    from lodestone.plans import catalogue, knowledge_queries

    rows = [(1, "a short one and another part"), (2, " ".join(f"w{i}" for i in range(26))), (3, "who? what?"), (4, "one two"), (5, " ".join(f"v{i}" for i in range(25)) + " and")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = knowledge_queries.rewrite_questions(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(catalogue.ORACLES["rewrite_questions"]).fetchall()) and len(got) == 9


def test_catalogue_matches_its_oracles(spark):
    import duckdb

    import __spark_entry__
    from lodestone.plans import catalogue

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return [str(x) for x in v]
        return None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    def flat(df):
        return sorted(str([cell(v) for v in row]) for row in df[sorted(df.columns)].itertuples(index=False))

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    for name, sql in catalogue.ORACLES.items():
        assert flat(catalogue.QUERIES[name](spark, sf).toPandas()) == flat(con.execute(sql).df()), name
    assert catalogue.QUERIES["ann_recall"](spark, sf).first()["recall"] >= 0.9
    several = catalogue.QUERIES["retrieve_several"](spark, sf)
    assert several.groupBy("query_id").count().where("count <> 5").count() == 0
