import json
import os

import pytest
import zstandard

from skein import cli
from skein.engine import Engine
from skein.functions.render import load_session, print_json, to_json, to_markdown, to_text
from skein.plans import commands
from skein.sources.stores import discover, probe, scan, selected
from skein.streaming.ingest import latest, refresh, stream_new_files


def write(path, lines, packed=False, frames=1):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = "".join(json.dumps(x) + "\n" if not isinstance(x, str) else x for x in lines).encode()
    if packed:
        cut = len(data) // frames + 1
        data = b"".join(zstandard.ZstdCompressor().compress(data[i : i + cut]) for i in range(0, len(data), cut))
    with open(path, "wb") as f:
        f.write(data)


def say(role, text, m=0, **more):
    return {"type": role, "timestamp": f"2025-01-01T10:{m:02}:00Z", "cwd": "/work", "message": {"role": role, "content": text} | more}


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    d = tmp_path_factory.mktemp("stores")
    write(f"{d}/claude/-work-a/c1.jsonl", [say("user", "Where is the LADDER now"), say("assistant", "behind the green ladder shed\r", 1, model="m1")])
    write(f"{d}/claude/-work-a/sub/deep.jsonl", [say("user", "below")])
    write(f"{d}/claude/-work-a/c2.jsonl", [say("user", "nothing here"), '{"type":"user","mess\n'])
    write(f"{d}/codex/2025/01/rollout-2025-01-07T06-00-00-e220-7b1d.jsonl", [{"type": "session_meta", "payload": {"id": "own-id", "cwd": "/repo"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "which ladder?"}]}}])
    write(f"{d}/codex/other.jsonl", ["x\n"])
    user = lambda t: {"type": "user/message", "seq": 1, "time": 1740823200000, "data": {"content": [{"type": "text", "text": t}]}}
    write(f"{d}/dsh/~work-x/session-1/session.v3.jsonl.zstd", [user("three" + "x" * 50)] * 3, packed=True, frames=4)
    write(f"{d}/dsh/~work-x/session-1/session.jsonl.zstd", [user("old")], packed=True)
    write(f"{d}/dsh/~work-x/session-2/session.v3.jsonl.zstd", [])
    write(f"{d}/dsh/~work-x/session-2/session.jsonl.zstd", [user("legacy")], packed=True)
    with open(f"{d}/dsh/~work-x/session-2/broken.zstd", "wb") as f:
        f.write(b"not zstd")
    return {n: f"{d}/{n}" for n in ("claude", "codex", "dsh")}


@pytest.fixture(scope="module")
def engine(spark, roots):
    return Engine(spark, roots)


def test_discovery(spark, roots):
    got = {r.id: r for r in discover(spark, roots).collect()}
    assert set(got) == {"c1", "c2", "e220-7b1d", "session-1", "session-2"}
    assert got["c1"].cwd == "/work/a" and got["session-1"].cwd == "/work/x" and got["session-1"].path.endswith("v3.jsonl.zstd") and got["session-2"].path.endswith("/session.jsonl.zstd")
    assert discover(spark, {"claude": "/no/such/folder"}).count() == 0 and selected(" DSH, claude,zzz") == ["claude", "dsh"] and selected("zzz") == []


def test_folded_store(engine):
    t = {r.id: r for r in engine.transcripts.collect()}
    assert t["own-id"].file_id == "e220-7b1d" and t["c2"].malformed == 1 and t["c1"].model == "m1" and t["session-1"].messages == 3 and t["session-2"].title == "legacy"
    assert engine.unreadable().count() == 0


def test_search(engine):
    args = engine.turns, engine.sessions, engine.transcripts
    hits = commands.search(*args, "ladder").collect()
    assert [(h.session, h.role, h.turn) for h in hits][:2] == [("c1", "assistant", 1), ("c1", "user", 0)] and hits[-1].time == "-" and len(hits) == 3
    assert commands.search(*args, "LADDER", limit=1).count() == 1 and commands.search(*args, "walrus").count() == 0
    assert commands.search(*args, "ladder", prefilter=commands.containing(engine.records, "green")).count() == 2
    assert commands.search(*args, "").count() == engine.turns.count()


def test_stats_and_lists(engine):
    rows = {r.key: r for r in commands.stats(engine.transcripts, total=True).collect()}
    assert rows["claude"].sessions == 2 and rows["TOTAL"].sessions == 5 and rows["TOTAL"].messages == sum(rows[k].messages for k in ("claude", "codex", "dsh"))
    assert {r.key for r in commands.stats(engine.transcripts, "model").collect()} == {"m1", "(unknown)"}
    assert commands.ls(engine.sessions, limit=2).count() == 2 and {r.title for r in commands.ls(engine.sessions).collect()} == {""}
    assert {r.source: r.sessions for r in commands.sources(engine.sessions).collect()} == {"claude": 2, "codex": 1, "dsh": 2}


def test_resolve(engine):
    s = engine.sessions
    assert commands.resolve(s, "C1").first().id == "c1" and commands.resolve(s).count() == 1
    with pytest.raises(commands.Unresolved):
        commands.resolve(s, "zzz")
    with pytest.raises(commands.Unresolved):
        commands.resolve(s, "session-")


def test_views(engine):
    row = engine.transcripts.where("id = 'c1'")
    t = load_session(engine.transcripts, engine.turns, row.first().path)
    text = to_text(t)
    assert text.startswith("claude  c1\ntitle  Where is the LADDER now\ncwd    /work\n") and "(1m0s)" in text and "ASSISTANT · m1" in text
    md = to_markdown(row, engine.turns)
    assert md.startswith("# Where is the LADDER now\n\n| | |\n") and "## User\n\nWhere is the LADDER now\n" in md and "| Harness | `claude` |" in md
    doc = json.loads(to_json(t))
    assert doc["Source"] == "claude" and [x["Role"] for x in doc["Turns"]] == ["user", "assistant"] and print_json(["<&>"]) == '[\n  "\\u003c\\u0026\\u003e"\n]'


def test_probe(spark, roots):
    base = f"{roots['dsh']}/~work-x"
    got = {os.path.basename(os.path.dirname(r.path)) + "/" + os.path.basename(r.path): r for r in probe(spark, [f"{base}/session-1/session.jsonl.zstd", f"{base}/session-2/broken.zstd", f"{base}/none"]).collect()}
    assert got["session-1/session.jsonl.zstd"].status == "OK" and got["session-2/broken.zstd"].status == "ERROR"


def test_views_for_sql(spark, engine):
    engine.register_views()
    assert spark.sql("SELECT count(*) FROM turns t JOIN blocks b USING (path, turn_idx) WHERE b.kind = 'text'").first()[0] == engine.turns.count()
    assert spark.sql("SELECT source, count(*) FROM sessions GROUP BY CUBE (source)").count() == 4


def test_probe_command(roots, capsys):
    base = f"{roots['dsh']}/~work-x"
    assert cli.main(["probe", f"{base}/session-1/session.jsonl.zstd"]) == 0 and "\tOK\t" in capsys.readouterr().out
    assert cli.main(["probe", f"{base}/session-1/session.jsonl.zstd", f"{base}/session-2/broken.zstd"]) == 1


def test_prefiltered_search(engine, roots, capsys):
    kept, counts = engine.narrowed("Ladder")
    assert counts == {"scanned": 2, "skipped": 3, "unreadable": 0} and kept.sessions.count() == 2
    assert commands.search(kept.turns, kept.sessions, kept.transcripts, "ladder").count() == 3
    assert engine.narrowed("ladder", False)[1] == {"scanned": 5, "skipped": 0, "unreadable": 0} and engine.narrowed("walrus")[1]["skipped"] == 5
    assert cli.main(["search", "ladder", "--prefilter", *(f"--root={n}={d}" for n, d in roots.items())]) == 0 and "2 session(s) scanned, 3 skipped, 0 unreadable" in capsys.readouterr().err


def test_command_line(roots, capsys, tmp_path):
    opts = [f"--root={n}={d}" for n, d in roots.items()]
    assert cli.main(["help"]) == 0 and cli.main([]) == 0 and cli.main(["nonsense"]) == 2 and cli.main(["search"]) == 2
    assert cli.main(["sources", *opts]) == 0 and cli.main(["list", "--json", *opts]) == 0
    capsys.readouterr()
    assert cli.main(["grep", "green ladder", "--json", *opts]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 1
    assert cli.main(["search", "walrus", *opts]) == 1 and cli.main(["stats", "--by", "model", *opts]) == 0 and cli.main(["show", "zzz", *opts]) == 1
    assert cli.main(["export", "c1", "--format", "md", "--out", f"{tmp_path}/x.md", *opts]) == 0 and open(f"{tmp_path}/x.md").read().startswith("# Where")
    assert cli.main(["export", "c1", "--format", "pdf", *opts]) == 2


def test_refresh_parses_only_changes(spark, roots, tmp_path):
    store = f"{tmp_path}/silver"
    assert refresh(spark, discover(spark, roots), store) == 5 and refresh(spark, discover(spark, roots), store) == 0
    path = f"{roots['claude']}/-work-a/c2.jsonl"
    with open(path, "a") as f:
        f.write(json.dumps(say("user", "more")) + "\n")
    assert refresh(spark, discover(spark, roots), store) == 1
    assert latest(spark, store, "turns").where("path like '%c2.jsonl'").count() == 2 and latest(spark, store, "transcripts").count() == 5


def test_stores_by_uri_pattern_and_splits(spark, roots, engine, tmp_path):
    uris = {n: f"file://{d}" for n, d in roots.items()}
    assert {r.path for r in discover(spark, uris).collect()} == {r.path for r in engine.sessions.collect()}
    lines = lambda df: sorted(map(tuple, df.collect()))
    want = lines(engine.records)
    assert {r[2] for r in want if r[1].endswith("c2.jsonl")} >= {1, 2}
    assert lines(scan(engine.sessions, uris, listed=0)) == want and len(want) > 8
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # lines cross the ends of splits
        assert lines(scan(engine.sessions, whole_bytes=10)) == want and lines(scan(engine.sessions, uris, 0, 10)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.status for r in probe(spark, [f"{uris['claude']}/-work-a/c1.jsonl", "/no/file"]).collect()} == {"OK", "ERROR"}
    assert refresh(spark, discover(spark, uris), f"file://{tmp_path}/s") == 5 and refresh(spark, discover(spark, uris), f"file://{tmp_path}/s") == 0


def test_a_crash_between_two_writes(spark, roots, tmp_path, monkeypatch):
    from skein.streaming import ingest

    found, store = discover(spark, roots, "claude"), f"{tmp_path}/store"
    with monkeypatch.context() as m:
        m.setattr(ingest, "fold_transcripts", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            refresh(spark, found, store)
    with monkeypatch.context() as m:

        class Broken:
            withColumn = lambda self, *_: 1 / 0

        m.setattr(ingest, "fold_transcripts", lambda *_: Broken())
        with pytest.raises(ZeroDivisionError):
            refresh(spark, found, store)
    assert os.path.isdir(f"{store}/turns") and refresh(spark, found, store) == 2
    assert latest(spark, store, "turns").count() == 3 and spark.read.parquet(f"{store}/turns").count() == 6


def test_compressed_stream(spark, roots, tmp_path):
    for _ in range(2):
        stream_new_files(spark, "dsh", f"{roots['dsh']}/*/*/session.jsonl.zstd", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["legacy", "old"]


def test_skippable_frames(spark, tmp_path):
    line = json.dumps(say("user", "packed")).encode() + b"\n"
    frame = zstandard.ZstdCompressor().compress
    skip = b"\x5a\x2a\x4d\x18" + (7).to_bytes(4, "little") + b"comment"
    path = f"{tmp_path}/dsh/~w/session-9/session.v3.jsonl.zstd"
    os.makedirs(os.path.dirname(path))
    with open(path, "wb") as f:
        f.write(skip + frame(line) + skip + frame(line) + skip)
    found = discover(spark, {"dsh": f"{tmp_path}/dsh"}, "dsh")
    assert [r.line_no for r in scan(found).orderBy("line_no").collect()] == [1, 2]


def test_stream(spark, roots, tmp_path):
    q = stream_new_files(spark, "claude", f"{roots['claude']}/*/*.jsonl", f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").where("path like '%c1.jsonl'").count() == 2
