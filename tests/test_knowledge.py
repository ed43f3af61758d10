import os
import time

import pytest

from lodestone.functions.errors import Refused
from lodestone.knowledge import KnowledgeBase, pending
from lodestone.sources import store as S


def rows(spark, *texts):
    return spark.createDataFrame([(*t, i) for i, t in enumerate(texts)], "text string, source string, origin string, seq long")


@pytest.fixture
def kb(spark, tmp_path):
    return KnowledgeBase(spark, str(tmp_path / "kb"))


def outcomes(df):
    return {r["doc_key"]: r["outcome"] for r in df.collect()}


def test_ingest_skips_and_replaces(spark, kb):
    harbour, tide = ("The harbour master keeps the keys of every shed on the quay.", "/n/harbour.txt", ""), ("Tide tables hang beside the door of the old office.", "Tides", "https://h.net/t.md")
    assert outcomes(kb.add(rows(spark, harbour, tide, (None, "/n/x.txt", ""), ("y" * 500_001, "/n/y.txt", "")))) == {"/n/harbour.txt": "saved", "https://h.net/t.md": "saved", "/n/x.txt": "empty", "/n/y.txt": "too long"}
    assert set(outcomes(kb.add(rows(spark, harbour, tide))).values()) == {"unchanged"}
    before = {r["id"] for r in kb.list().collect()}
    new = ("The keys are with the night watch now, in a tin box.", *harbour[1:])
    assert outcomes(kb.add(rows(spark, harbour, new)))["/n/harbour.txt"] == "saved"  # the last row of a document counts
    texts = [r["text"] for r in kb.list().collect()]
    assert len(texts) == 2 and any("tin box" in t for t in texts) and not any("every shed" in t for t in texts)
    assert max(r["id"] for r in kb.list().collect()) > max(before) and kb.diagnose().first()["mismatch"] is False
    assert [r["label"] for r in kb.search("who holds the keys in the box", 3).where("rank = 1").collect()] == ["/n/harbour.txt"]
    assert kb.search("every shed").where("snippet like '%every shed%'").count() == 0  # the keyword index follows


def test_notes_and_deletion(spark, kb):
    note = "Remember to oil the hinges of the boathouse door before winter comes."
    got = kb.add(rows(spark, (note, "typed", ""), (note, "typed", ""), ("A wholly different thought about lanterns and fog.", "typed", ""), ("Ropes are in the loft.", "/n/ropes.txt", ""), ("Ropes and nets lie about in the shed.", "/n/ropes.txt", "/o/ropes.txt")))
    assert sorted(r["outcome"] for r in got.collect()) == ["saved", "saved", "saved", "saved", "too similar"]
    assert [r["outcome"] for r in kb.add(rows(spark, (note, "typed", ""))).collect()] == ["too similar"]
    assert kb.delete_document("/n/ropes.txt") == 1 and kb.delete_document("/n/ropes.txt", "/o/none") == 0
    left = {r["doc_key"] for r in kb.list().collect()}
    assert "/o/ropes.txt" in left and "/n/ropes.txt" not in left and len(left) == 3
    with pytest.raises(Refused):
        kb.delete("1;2")
    n = kb.list().count()
    assert kb.delete("1-100") == n and kb.list().count() == 0 and kb.relations().count() == 0 and kb.delete("5") == 0
    assert kb.store.read("vectors").count() == 0


def test_versions(spark, kb):
    kb.add(rows(spark, ("Sails are mended in the long loft above the chandlery.", "/n/a.txt", ""), ("Sails are mended in the long loft above the chandler.", "/n/b.txt", "")))
    first = kb.store.meta()
    edges = kb.relations().collect()
    assert [(r["source_id"], r["target_id"]) for r in edges] == [(2, 1)] and 0 <= edges[0]["distance"] < 0.32
    kb.reindex_edges()
    assert {(r["source_id"], r["target_id"]) for r in kb.relations().collect()} == {(1, 2), (2, 1)}
    kb.reindex()
    kb.replace_vector(spark.createDataFrame([(1, [1.0] + [0.0] * 63), (77, [0.0] * 64)], "id long, embedding array<float>"))
    v = {r["id"]: r["embedding"] for r in kb.store.read("vectors").collect()}
    assert v[1][0] == 1.0 and set(v) == {1, 2}
    kb.delete("1")
    assert kb.store.read("chunks", first).count() == 2  # an older version stays readable
    kb.store.compact()
    assert [r["id"] for r in kb.list().collect()] == [2] and len(kb.store.meta()["tables"]["chunks"]) == 1
    old = kb.store.meta()
    part = f"{kb.store.path}/parts/old"
    spark.createDataFrame([(9, "text", "typed", "", "chunk:9")], "id long, text string, source string, origin string, doc_key string").write.parquet(part)
    kb.store._publish({**old, "format": 1, "tables": {**old["tables"], "chunks": [{"rows": part}]}})
    row = kb.store.read("chunks").first()
    assert (row["heading_path"], row["chunk_index"], row["content_type"]) == ("", 0, "")
    kb.clear()
    assert kb.list().count() == 0 and kb.store.meta()["next_id"] == 1
    assert S.Store(spark, kb.store.path).meta()["version"] == kb.store.meta()["version"]


def test_documents_graph_and_answers(spark, tmp_path, kb):
    path = tmp_path / "notes"
    path.mkdir()
    (path / "keel.md").write_text("# Keel\nThe keel is laid of one straight piece of oak.\n")
    (path / "mast.txt").write_text("The mast is cut of one straight piece of spruce.")
    from lodestone.sources.files import read_files

    assert set(outcomes(kb.add_files(read_files(spark, str(path)))).values()) == {"saved"}
    kb.add_pages(spark.createDataFrame([("A page about one straight piece of oak and keels.", "https://h.net/oak", "Oak"), ("Some more text about rigging.", "https://h.net/rig", None)], "text string, url string, title string"))
    (path / "mast.txt").write_text("The mast has since been cut anew, of larch this time.")
    d = kb.document("mast.txt").first()
    assert d["content_source"] == "file" and "larch" in d["content"] and d["size_bytes"] > 0 and d["chunk_count"] == 1 and len(d["ingestion_hash"]) == 64
    assert kb.document("https://h.net/oak").first()["label"] == "Oak" and kb.document("https://h.net/rig").first()["label"] == "h.net"
    for call, error in ((lambda: kb.document("no such name"), LookupError), (lambda: kb.document(" "), Refused), (lambda: kb.search("  "), Refused), (lambda: kb.neighbourhood("none", 1), LookupError)):
        with pytest.raises(error):
            call()
    kb.reindex_edges(0.9)
    nodes, edges = kb.neighbourhood("keel.md", 2)
    assert nodes.where("depth = 0").first()["document_id"].endswith("keel.md") and edges.count() >= 1 and edges.where("abs(similarity + distance - 1) > 1e-9").count() == 0
    assert kb.nearest_pairs().count() == 4 and kb.debug("oak keel").count() == 4
    prompt = kb.debug_prompt("keel of oak? --source")
    assert "its document" in prompt and "PASSAGES" in prompt
    kb.verifier = lambda prompts: ["1"] * len(prompts)
    kb.reranker = lambda prompts: ["2, 1"] * len(prompts)
    stream = kb.query("keel of oak", lambda prompts: ["The keel is made of straight oak."] * len(prompts))
    head, rest = stream.split("\n", 1)
    assert '"sources":[' in head and rest.startswith("The keel is made") and "100% (1/1" in rest


def test_folder_stream(spark, tmp_path, kb):
    from lodestone.streaming.folder import FolderReader, ingest, watch

    path = tmp_path / "in"
    path.mkdir()
    (path / "a.md").write_text("The first version of a text about anchors.")
    reader = FolderReader({"path": str(path)})
    time.sleep(0.1)
    start, end = reader.initialOffset(), reader.latestOffset()
    read = lambda a, b: [bytes(r[2]) for p in reader.partitions(a, b) for r in reader.read(p)]
    assert read(start, end) == [b"The first version of a text about anchors."] and reader.latestOffset() == end
    claims = str(tmp_path / "claims")
    spark.createDataFrame([(f"{path}/claimed.md",)], "path string").write.parquet(claims)
    (path / "claimed.md").write_text("A text that came in by another way before.")
    query = ingest(watch(spark, str(path)), kb, str(tmp_path / "cp"), claims)
    try:
        for text in ("The first version of a text about anchors.", "The second version of it, about capstans."):
            (path / "a.md").write_text(text)
            for _ in range(60):
                time.sleep(0.5)
                if [r["text"] for r in kb.list().collect()] == [text]:
                    break
            assert [r["text"] for r in kb.list().collect()] == [text], query.exception()
    finally:
        query.stop()
    assert os.path.exists(tmp_path / "cp")


def test_claims_hold_once(spark):
    paths = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "path string, version long")
    got = pending(paths, spark.createDataFrame([("a",), ("c",), ("x",)], "path string")).orderBy("path").collect()
    assert [(r["path"], r["version"]) for r in got] == [("a", 2), ("b", 1)]
    assert pending(paths.select("path"), spark.createDataFrame([], "path string")).count() == 4
