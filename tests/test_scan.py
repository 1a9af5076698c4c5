"""The pattern audit of Markdown and the sampled run."""

import re

import pytest

from spanforge.operators import scan


@pytest.fixture
def md(spark):
    return lambda *texts: spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, markdown string")


def test_patterns_against_plain(md):
    texts = ["一、，总则\n己经 ok\n编号\n 度” x\n二、\nplain", "A MTPS-12 x\n编号 MTPS-3\n保密资料\n\n己经" * 5, "", None, "clean"]
    got = sorted((r.doc_id, r.type, r.line, r.text) for r in scan.pattern_matches(md(*texts), "doc_id").collect())
    want = []
    for i, t in enumerate(texts, 1):
        for kind, p in scan.RESIDUE.items():
            found = list(re.finditer(p.replace(r"\x{FFFD}", "�"), t or ""))[:8]
            want += [(i, kind, t.count("\n", 0, m.start()) + 1, m[0][:80]) for m in found]
    assert got == sorted(want) and want


def test_orphan_numbers(md):
    got = scan.orphan_numbers(md("这是正文\n12\n\nx", "plain\n12\nwords", "a\nb\nc\nd\n7\n目录", "1234\n正文正文"), "doc_id").collect()
    assert sorted((r.doc_id, r.line, r.text) for r in got) == [(1, 2, "12"), (3, 5, "7")]


def test_records(md):
    text = "- 一级分类：安全\n  检核项目：1.健康证\n  内容：持证上岗\n  责任承担：100元/项/次，整改\n\nother\n- 一级分类：内容；检核项目：x\n- 一级分类：站点\n  检核项目：控\n  内容：设备损坏"
    got = scan.record_issues(md(text), "doc_id").collect()
    assert sorted((r.line, r.text) for r in got) == [(1, "duty"), (7, "no item"), (7, "one line"), (8, "content"), (8, "item")]


def test_report(md):
    docs = md("己经 表格结构需核对", "clean")
    got = {r.doc_id: (r.issue_count, r.table_fallbacks, r.ok) for r in scan.report(docs, scan.scan(docs)).collect()}
    assert got == {1: (1, 1, False), 2: (0, 0, True)}


def test_sampled_audit(spark, sf_dir, capsys):
    from spanforge.plans import check

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ids = [r.page_id for r in pages.select("page_id").orderBy("page_id").collect()]
    report = check.run_audit(pages, 3, len(ids) - 1)
    assert [r["page"] for r in report["results"]] == [ids[-1], ids[0], ids[1]] and report["total"] == len(ids)
    assert report["ok"] == all(r["ok"] for r in report["results"])
    assert not check.run_audit(pages.limit(0))["ok"]
    code = check.main([f"{sf_dir}/pages.parquet", "--sample-size", "1"])
    assert capsys.readouterr().out.startswith("ok" if code == 0 else "issues found")
