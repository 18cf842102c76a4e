import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chronofact.sources import archive, files, release
from chronofact.streaming import ingest


def member(i):
    return archive.AGGREGATE_NAME if i == 0 else f"{i:02d}_2026-01-01_Source_{i}.md"


def make_archive(folder, count=225, extra=()):
    path = folder / "sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(count):
            z.writestr(f"Policies/{member(i)}", f"source {i}\r\n".encode())
        z.writestr("Policies/notes.txt", b"ignored")
        for name in extra:
            z.writestr(name, b"extra\r\n")
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_materialize_keeps_bytes_and_is_deterministic(spark, tmp_path):
    digest = make_archive(tmp_path)
    reports = [archive.materialize(spark, str(tmp_path), str(tmp_path / out), digest).first() for out in ("a", "b")]
    assert (reports[0]["markdown_files"], reports[0]["individual_articles"], reports[0]["aggregate_files"]) == (225, 224, 1)
    lines = b"".join(member(i).encode() + b"\0" + hashlib.sha256(f"source {i}\r\n".encode()).hexdigest().encode() + b"\n" for i in range(225))
    assert reports[0]["member_digest"] == reports[1]["member_digest"] == hashlib.sha256(lines).hexdigest()
    stored = spark.read.parquet(str(tmp_path / "a"))
    assert bytes(stored.where("prefix = 7").first()["content"]) == b"source 7\r\n"
    with pytest.raises(Exception, match="(?i)already exists"):
        archive.materialize(spark, str(tmp_path), str(tmp_path / "a"), digest)


@pytest.mark.parametrize("count,extra,hash_ok,message", [
    (225, (), False, "not the pinned one"), (224, (), True, "not all there once"), (225, ("../escape.md",), True, "leaves the archive"),
    (225, (f"Other/{member(3)}",), True, "share a name"), (225, ("Policies/readme.md",), True, "without a number")])
def test_materialize_rejects_bad_archives(spark, tmp_path, count, extra, hash_ok, message):
    digest = make_archive(tmp_path, count, extra)
    with pytest.raises(ValueError, match=message):
        archive.materialize(spark, str(tmp_path), str(tmp_path / "out"), digest if hash_ok else "0" * 64)
    assert not (tmp_path / "out").exists()


def test_missing_archive(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="missing pinned source archive"):
        archive.materialize(spark, str(tmp_path), str(tmp_path / "out"), "0" * 64)


def test_member_names(spark):
    names = {"a/b.md": True, "/a.md": False, "../x.md": False, "a/../b": False, "": False, ".": False, "C:/x.md": False, "a\\..\\b": False,
             "a/./b.MD": True, "dir/": True, "c:x": True}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["s"] for r in df.select("n", files.safe_member("n").alias("s")).collect()} == names
    row = spark.createDataFrame([("d\\07_x_y.MD",)], "n string").select(
        files.base_name("n"), files.numeric_prefix("n"), files.is_markdown("n")).first()
    assert tuple(row) == ("07_x_y.MD", 7, True)


def test_jsonl_round_trip_is_canonical_and_strict(spark, tmp_path):
    rows = [(2, "é", None), (1, "b", ["x"])]
    df = spark.createDataFrame(rows, "id long, b string, a array<string>")
    files.write_jsonl(df.coalesce(1), str(tmp_path / "out"), ["id"])
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode()
    assert text == '{"a":["x"],"b":"b","id":1}\n{"a":null,"b":"é","id":2}\n'
    assert sorted(files.read_jsonl(spark, str(tmp_path / "out"), df.schema).collect()) == sorted(df.collect())
    (tmp_path / "bad.jsonl").write_text('{"id":1}\n\n{broken\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id long").collect()


def test_markdown_scan_keeps_line_ends(spark, tmp_path):
    (tmp_path / "r.md").write_bytes("một\r\nhai\n".encode())
    row = files.read_markdown(spark, str(tmp_path)).first()
    assert (row["path"], row["text"], row["crlf"]) == ("r.md", "một\r\nhai\n", True)
    assert row["sha256"] == hashlib.sha256("một\r\nhai\n".encode()).hexdigest()


def sha(path):
    return hashlib.sha256(path.read_bytes()).hexdigest()


def frozen(folder):
    root = folder / "release-test"
    (root / "public").mkdir(parents=True)
    (root / "private/eval").mkdir(parents=True)
    (root / "public/payload.txt").write_bytes(b"payload\n")
    (root / release.VALIDATION).write_text('{"state":"VALIDATED"}\n')
    listed = {p: sha(root / p) for p in ("public/payload.txt", release.VALIDATION)}
    (root / release.MANIFEST).write_text(json.dumps({
        "state": "FROZEN", "dataset_version": root.name, "logical_inventory_digest": "d", "validation_sha256": listed[release.VALIDATION],
        "file_inventory": listed}))
    comparison = folder / "comparison.json"
    comparison.write_text(json.dumps({"status": "pass", "mismatches": [], "inventory_digest": "d"}))
    certificate = folder / "certificate.json"
    certificate.write_text(json.dumps({
        "dataset_version": root.name, "state": "FROZEN", "manifest_sha256": sha(root / release.MANIFEST),
        "comparison_report_sha256": sha(comparison), "logical_inventory_digest": "d",
        "dfg": {f"DFG{i:02d}": {"status": "pass"} for i in range(1, 7)}}))
    return root, certificate, comparison


def verify(spark, paths):
    report, findings, errors = release.verify_frozen(spark, *map(str, paths))
    return report.first().asDict(), {r["path"]: r["state"] for r in findings.collect()}, {r["error"] for r in errors.collect()}


def test_verify_passes_and_reads_only(spark, tmp_path):
    paths = frozen(tmp_path)
    before = {p: (p.read_bytes(), p.stat().st_mtime_ns) for p in tmp_path.rglob("*") if p.is_file()}
    report, findings, errors = verify(spark, paths)
    assert (report["status"], report["declared"], report["checked"], findings, errors) == ("pass", 2, 2, {}, set())
    assert before == {p: (p.read_bytes(), p.stat().st_mtime_ns) for p in tmp_path.rglob("*") if p.is_file()}


def test_verify_reports_mutated_missing_and_unexpected(spark, tmp_path):
    paths = frozen(tmp_path)
    (paths[0] / "public/payload.txt").write_bytes(b"mutated\n")
    (paths[0] / release.VALIDATION).unlink()
    (paths[0] / "unexpected.bin").write_bytes(b"extra")
    report, findings, _ = verify(spark, paths)
    assert report["status"] == "fail"
    assert findings == {"public/payload.txt": "mismatched", release.VALIDATION: "missing", "unexpected.bin": "unexpected"}


def test_verify_reports_contradicting_documents(spark, tmp_path):
    root, certificate, comparison = frozen(tmp_path)
    cert = json.loads(certificate.read_text())
    cert.update(manifest_sha256="0" * 64, logical_inventory_digest="2" * 64)
    cert["dfg"]["DFG06"]["status"] = "not_run"
    certificate.write_text(json.dumps(cert))
    manifest = json.loads((root / release.MANIFEST).read_text())
    (root / release.MANIFEST).write_text(json.dumps({**manifest, "state": "VALIDATED"}))
    comparison.write_text(json.dumps({"status": "fail", "mismatches": [{"path": "x"}], "inventory_digest": "d"}))
    report, findings, errors = verify(spark, (root, certificate, comparison))
    assert report["status"] == "fail" and findings == {}
    assert errors == {"release state is not FROZEN", "manifest SHA-256 mismatch", "comparison report SHA-256 mismatch",
                      "logical inventory digest mismatch", "comparison report does not record a clean pass", "DFG06 is not pass"}


def test_compare_releases(spark, tmp_path):
    for name, body in (("a", b"1"), ("b", b"2")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "same.txt").write_bytes(b"x")
        (tmp_path / name / "f.txt").write_bytes(body)
    got = {r["path"]: r["state"] for r in release.compare_releases(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got == {"same.txt": "match", "f.txt": "mismatched"}


def test_stream_resumes_after_the_last_batch_and_repeats_count_once(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    write = lambda rows: spark.createDataFrame(rows, "record_id string, n int").write.mode("append").json(source)
    run = lambda: ingest.append(spark.readStream.schema("record_id string, n int").json(source), table, checkpoint).awaitTermination()
    write([("r1", 1), ("r2", 2)])
    run()
    run()
    assert spark.read.parquet(table).count() == 2
    write([("r2", 2), ("r3", 3)])
    run()
    stored = spark.read.parquet(table)
    assert stored.count() == 4
    assert sorted(r["n"] for r in ingest.stored_once(stored, "record_id").collect()) == [1, 2, 3]


def make_corpus(folder):
    from chronofact.sources import corpus  # noqa: F401
    root = folder / "public"
    for sub in ("corpus_profiles/p", "documents/normalized", "documents/raw", "definitions"):
        (root / sub).mkdir(parents=True)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    texts = {"rev1": "một hai\nba", "rev2": "bốn năm", "rev3": "not in profile"}
    raws = {"snap-1": texts["rev1"].replace("\n", "\r\n").encode(), "rev2": texts["rev2"].encode()}
    for name, text in texts.items():
        (root / f"documents/normalized/{name}.md").write_bytes(text.encode())
    for name, raw in raws.items():
        (root / f"documents/raw/{name}.md").write_bytes(raw)
    rows = [{"snapshot_id": "snap-1", "document_revision_id": "rev1", "normalized_sha256": digest(texts["rev1"].encode()),
             "raw_sha256": digest(raws["snap-1"]), "clauses": [{"clause_id": "c", "span_start": 4, "span_end": 7}]},
            {"snapshot_id": None, "document_revision_id": "rev2", "normalized_sha256": digest(texts["rev2"].encode())},
            {"snapshot_id": "snap-3", "document_revision_id": "rev3"}]
    (root / "documents/catalog.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (root / "definitions/d1.md").write_bytes(b"# M01\n\nbody")
    defs = [{"definition_id": "d1", "content_sha256": "0" * 64}, {"definition_id": "d1", "content_sha256": digest(b"# M01\n\nbody")}]
    (root / "definitions/catalog.jsonl").write_text("\n".join(map(json.dumps, defs)) + "\n")
    profile = {"corpus_profile_version": "1", "real_snapshot_ids": ["snap-1"], "shared_document_revision_ids": ["rev2"], "definition_ids": ["d1"]}
    (root / "corpus_profiles/p/manifest.json").write_text(json.dumps(profile))
    return root, profile


def test_corpus_to_chunks(spark, tmp_path):
    from chronofact.operators import chunking
    from chronofact.sources import corpus
    root, profile = make_corpus(tmp_path)
    chunks = chunking.construct_chunks(corpus.corpus_sources(spark, str(root), "p"), profile_id="p").collect()
    got = {r["source_id"]: (r["kind"], r["text"], r["raw_end"], r["clause_ids"]) for r in chunks}
    assert got == {"snap-1": ("document", "một hai\nba", 11, ["c"]), "rev2": ("document", "bốn năm", 7, []),
                   "d1": ("definition", "# M01\n\nbody", 11, [])}
    (root / "documents/raw/snap-1.md").write_bytes(b"other")
    with pytest.raises(Exception, match="raw hash mismatch"):
        corpus.corpus_sources(spark, str(root), "p").collect()
    (root / "corpus_profiles/p/manifest.json").write_text(json.dumps({**profile, "definition_ids": ["d1", "d9"]}))
    with pytest.raises(Exception, match="unknown definition: d9"):
        corpus.corpus_sources(spark, str(root), "p").where("kind = 'definition'").collect()


def test_article_counts_and_single_document(spark, tmp_path):
    make_archive(tmp_path)
    row = archive.article_counts(archive.markdown(archive.members(spark, str(tmp_path)))).first()
    assert (row["real_articles"], row["aggregate_excluded"], row["audited"]) == (224, 1, 6)
    files.write_json(spark.createDataFrame([(1, "é")], "b int, a string"), str(tmp_path / "doc"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "doc").glob("part-*")).decode() == '{"a":"é","b":1}\n'
    with pytest.raises(ValueError, match="exactly one row"):
        files.write_json(spark.range(2), str(tmp_path / "two"))


def test_scratch_tables_go_when_the_caller_says_so(spark):
    from pathlib import Path

    from chronofact.session import scratch_path, scratch_scope

    with scratch_scope(spark) as outer:
        with scratch_scope(spark) as inner:
            paths = [scratch_path(spark, "scope-test") for _ in range(3)]
            for path in paths[:2]:
                spark.range(3).write.parquet(path)
        assert inner.paths == outer.paths == paths
        inner.release(keep=paths[1:2])
        there = [Path(p.removeprefix("file:")).exists() for p in paths]
        assert there == [False, True, False] and inner.paths == paths[1:2]
        assert spark.read.parquet(paths[1]).count() == 3
    outside = scratch_path(spark, "scope-test")
    assert outside not in outer.paths
    outer.release()
    assert not Path(paths[1].removeprefix("file:")).exists() and outer.paths == []
