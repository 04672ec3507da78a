"""Operator 10's query on ids and sources that make no path."""

from revverify.llm import licenses


def test_ids_are_carried(spark, tmp_path):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (None, mit, "src0"), (None, "nothing", "src0"), (None, apache, "plain"), (None, None, None), (0, "nothing", "src0"), (-5, mit, "src0"), (5, "nothing", "src0"),
        (-20, apache, "src1"), (-7, "nothing", "src1"), (3, mit, None), (4, "nothing", None), (2**60 + 1, mit, "src9"), (2**60 + 1, mit, "src9"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = [(r["doc_id"], r["own"], r["license"]) for r in licenses.op10_license_scan(spark, str(tmp_path)).collect()]
    want = {mit: "MIT", apache: "Apache-2.0"}
    got = sorted(((d, own) for d, own, _ in out), key=str)
    assert got == sorted(((d, want.get(t)) for d, t, _ in rows), key=str)
    assert {license for d, _, license in out if d == -7} == {"Apache-2.0"}  # from the licence file -20 of its directory


def test_units_beyond_lines(spark):
    body = licenses._MIT_GRANT + "\n\n" + licenses._MIT_WARRANTY
    wrapped = "\n".join(" * " + licenses.TEMPLATES[2][1][i : i + 60] for i in range(0, len(licenses.TEMPLATES[2][1]), 60))
    long_line = " ".join(f"word{i}" for i in range(300)) + " This program is licensed under the GNU General Public License, version 2. " + " ".join(f"other{i}" for i in range(300))
    files = [
        ("p/LICENSE", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + body), ("p/src/a.c", "int x;"), ("q/a.py", "# SPDX-License-Identifier: LGPL-2.1-or-later\ncode"), ("q/b.c", "/*\n" + wrapped + "\n */\n\nint x;"),
        ("r/COPYING", licenses._BSD_GRANT + "\n" + licenses._BSD_WARRANTY), ("s/long.txt", "x " * 200_000 + "\nReleased under the MIT License."), ("s/one.txt", long_line), ("t/tie.txt", "Released under the MIT License.\nReleased under the MIT License."),
    ]
    rows = spark.createDataFrame([(*f, "mine", "x") for f in files], "path string, text string, own string, words string")
    out = {r["path"]: r for r in licenses.scan_licenses(rows).collect()}
    got = {p: r["license"] for p, r in out.items()}
    assert got == {
        "p/LICENSE": "MIT", "p/src/a.c": "MIT", "q/a.py": "LGPL-2.1-or-later", "q/b.c": "Apache-2.0", "r/COPYING": "BSD-2-Clause", "s/long.txt": "MIT", "s/one.txt": got["s/one.txt"], "t/tie.txt": "MIT",
    }
    assert got["s/one.txt"] in (None, "GPL-2.0")  # a notice among many rare words may stay below the threshold
    assert all(r["words"] == "x" for r in out.values())
