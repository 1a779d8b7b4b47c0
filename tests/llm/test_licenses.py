import regex

from brindle.llm import licenses


def brute(text: str, found: list[licenses.Notice]) -> set:
    """Best matches over the whole text, without seeds."""
    low, out = licenses.lowered(text), set()
    for n in found:
        pattern = regex.compile(f"(?b)(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}")
        todo = [(0, len(low))]
        while todo:
            a, b = todo.pop()
            m = pattern.search(low, a, b) if b - a >= len(n.text) - n.edits else None
            if m and m.end() > m.start():
                out.add((n.name, sum(m.fuzzy_counts)))
                todo += [(a, m.start()), (m.end(), b)]
    return out


def test_seeds_lose_nothing_that_a_search_of_the_whole_text_finds(spark, small):
    found = [n for n in licenses.notices() if n.name in ("Apache-2.0", "MIT", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-3.0")]
    scanner = licenses.Scanner(found)
    lines = [line for r in spark.read.parquet(f"{small}/documents.parquet").collect() for line in r.text.split("\n") if "icens" in line and len(line) < 300]
    texts = lines[:15] + ["x licenced under the apache licence, version 2.0 y", "RELEASED  UNDER THE MIT LICENSE" * 3, "nothing of the kind is said here"]
    hits = 0
    for text in texts:
        got = {(r[0], r[3]) for r in scanner.scan(text)}
        every = brute(text, found)
        names = {n for n, _ in every}
        assert got <= every
        assert {n for n, _ in got} <= names and (bool(got) == bool(every))
        hits += len(got)
    assert hits > 2


def test_each_number_of_edits(spark):
    base = "Distributed under the Boost Software License, Version 1.0"
    most = next(n for n in licenses.notices() if n.name == "Boost").edits
    rows = [(k, "before " + "#".join(base[i : i + 9] for i in range(0, 9 * k, 9)) + ("#" if k else "") + base[9 * k :] + " after") for k in range(1, most + 2)]
    got = {r.doc_id: r.edits for r in licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(1, most + 1)}


def test_spans_and_odd_rows(spark):
    t = "Released under the MIT License"
    rows = [(1, None), (2, ""), (None, t), (3, "İ " + t.upper() + " ß " + t), (3, "İ " + t.upper() + " ß " + t), (4, "a " * 100_000 + t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n", "notice", "start", "end", "edits", "matched"):
        docs = docs.withColumn(name, docs.doc_id)
    got = licenses.license_notices(docs).collect()
    assert sorted((str(r.doc_id), r.start, r.end, r.edits) for r in got if r.notice == "MIT") == sorted(
        [("None", 0, 30, 0), ("3", 2, 32, 0), ("3", 35, 65, 0), ("3", 2, 32, 0), ("3", 35, 65, 0), ("4", 200_000, 200_030, 0)]
    )
    assert licenses.license_notices(docs.limit(0)).count() == 0


def test_edited_version_3_notices_are_not_version_2():
    scanner = licenses.Scanner(licenses.notices())
    names = lambda text: {r[0] for r in scanner.scan(text)}
    core = "licensed under the GNU General Public License, version "
    for text in (
        "This file is " + core + "3", "Thus wrk is " + core + "3", core + "3", "This program is free software, " + core + "3 or later",
        "licenced under the GNU General Public Licence, version 3", "This work is licenced under the GNU General Public Licence version 3", "This work is " + core + "3",
    ):
        assert names(text) == {"GPL-3.0"}, text
        assert [r[3] for r in scanner.scan(text)][0] <= 5
    for text in (core + "2", "This work is " + core + "2", "licenced under the GNU General Public Licence, version 2"):
        assert "GPL-2.0" in names(text), text
    (exact,) = scanner.scan("x This work is " + core + "3 y")
    assert exact[1:4] == (2, 2 + len("This work is " + core + "3"), 0)


def test_no_match_gives_way_to_one_with_another_version():
    texts = {"old": "under the terms of the Plain Licence, version 2", "new": "Offered under the terms of the Plain Licence, version 3"}
    scanner = licenses.Scanner(licenses.notices(texts))
    assert "new" in {r[0] for r in scanner.scan("ofered, under the terms of the Plain Licence, version 3")}
