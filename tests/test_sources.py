"""Contract files and host profiles."""

import hashlib
import json

from folio.operators import profiles
from folio.sources import captures


def page(i, raw, **more):
    return {"page_id": f"p{i}", "requested_url": f"http://h/{i}", "input_kind": "HTTP_BYTES", "input_path": f"{i}.html", "http_metadata_path": f"{i}.json", "input_sha256": hashlib.sha256(raw).hexdigest(), **more}


def test_cases_and_expected_results(spark, tmp_path):
    raw = {1: b"<p>1</p>", 2: b"<p>2</p>", 3: b"<p>3</p>"}
    head = {"document_type": "benchmark_case", "annotation_status": "READY", "source_type": "synthetic", "entry_page_id": "p1", "expected_path": "e.json"}
    good = {"case": {"case_id": "good", **head, "pages": [page(1, raw[1]), page(2, raw[2])]}}
    bad = {"case": {"case_id": "bad", **head, "annotation_status": "DRAFT", "source_type": "guess", "entry_page_id": "p9", "pages": [page(3, b"other", requested_url="ftp://x", http_metadata_path=None), page(4, b"", input_kind="PRINT", input_sha256="1")]}}
    for name, x in (("a", good), ("b", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    files = spark.createDataFrame([(f"{i}.html", bytearray(b)) for i, b in raw.items()], "input_path string, raw_bytes binary")
    got = {(r["case_id"], r["page_id"]): (set(r["errors"]), r["raw_bytes"]) for r in captures.read_case(spark, str(tmp_path / "*.json"), files).collect()}
    assert got["good", "p1"] == (set(), raw[1]) and got["good", "p2"][0] == set()
    assert got["bad", "p3"][0] == {"not ready", "unknown source", "no http url", "no HTTP metadata", "unknown entry page", "another digest"}
    assert got["bad", "p4"][0] == {"not ready", "unknown source", "unknown kind of input", "no digest", "unknown entry page", "no input", "another digest"} - {"another digest"}
    cases = spark.createDataFrame([("good", "p1"), ("good", "p2")], "case_id string, page_id string")
    want = {"document_type": "benchmark_expected", "annotation_status": "READY", "case_id": "good", "page_labels": [{"page_id": "p1", "page_type": "CHAPTER_PAGE"}, {"page_id": "p7", "page_type": "UNKNOWN"}, {"page_id": "p2", "page_type": None}, {"page_id": "p2", "page_type": "BOOK_PAGE"}]}
    other = {**want, "document_type": "x", "case_id": "none", "page_labels": []}
    for name, x in (("w", want), ("o", other)):
        (tmp_path / f"{name}.exp").write_text(json.dumps(x))
    e = [(r["case_id"], r["page_id"], tuple(r["errors"])) for r in captures.read_expected(spark, str(tmp_path / "*.exp"), cases).collect()]
    assert sorted(e, key=str) == sorted([("good", "p1", ()), ("good", "p7", ("unknown page",)), *[("good", "p2", ("label repeated",))] * 2, ("none", None, ("no expected results", "unknown case", "no label"))], key=str)


def test_profile_counters(spark):
    p = spark.createDataFrame([("a", 1, None, 0, "x"), ("b", 2, 3, 4, None)], "host string, hits int, misses int, invalidations int, nav string")
    o = spark.createDataFrame([("a", "hits"), ("a", "hits"), ("a", "misses"), ("b", "odd"), ("c", "hits"), (None, "hits")], "host string, kind string")
    assert {tuple(r) for r in profiles.record(p, o).collect()} == {("a", 3, 1, 0, "x"), ("b", 2, 3, 4, None)}
    assert [r["host"] for r in profiles.invalidate(p, o.where("host = 'a'")).collect()] == ["b"] and profiles.invalidate(p).count() == 0
    assert p.select(profiles.safe_host(p["host"])).first()[0] == "a" and spark.createDataFrame([("h:80/x",)], "host string").select(profiles.safe_host("host")).first()[0] == "h_80_x"
