import json

from quern.operators import memory, search
from quern.sources import readers


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("words é")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.txt").write_text("")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.valid) for r in readers.payload_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("words é", True), "b.bin": (None, False)}


def test_transcripts(spark, tmp_path):
    for k, (updated, status) in enumerate([(1_000_000, "done"), (1_000_100, "pending"), (10, "pending")]):
        entry = {"id": "e", "ts": updated, "kind": "call", "payload": "p", "status": status, "result": None, "command": "ls"}
        (tmp_path / f"s{k}.json").write_text(json.dumps({"session_id": f"s{k}", "updated_at": updated, "entries": [entry, entry]}))
    entries = readers.transcripts(spark, str(tmp_path), 5, 1_000_200, 1)
    assert entries.count() == 4
    assert [(r.session_id, r.pending) for r in readers.pending_session(entries).collect()] == [("s1", 2)]


def test_source_tree_to_graph(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\nfrom pkg.b import c\nimport os\n")
    (tmp_path / "src" / "b.js").write_text("import x from './c'\nconst y = require('z')\n")
    (tmp_path / "node_modules" / "n.js").write_text("import x from 'w'\n")
    (tmp_path / "src" / "t.txt").write_text("import no\n")
    files = readers.source_tree(spark, str(tmp_path))
    edges = {(r.source, r.target) for r in memory.import_edges(files).collect()}
    assert edges == {("src/a.py", "os"), ("src/a.py", "pkg.b"), ("src/b.js", "./c"), ("src/b.js", "z")}
    assert search.imported_by(memory.import_edges(files)).where("node = 'os'").first().importers == ["src/a.py"]
