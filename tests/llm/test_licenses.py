import collections
import math
import re
import textwrap

import regex
from llm_util import awkward, empty
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gavel.llm import licenses as L
from gavel.llm.common import table


def words(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def parts_of(path, text):
    """Lines and sentences, wrapped sentences, blocks, runs of comment lines, and whole licence files."""
    runs = [re.sub(L.CODE_LINE, "", x, count=1) for x in re.split(L.NO_COMMENT, text)]
    return [*re.split(L.SENTENCE, text), *regex.split(L.WRAPPED, text), *re.split(L.BLOCK, text), *runs, *([text] if re.search(L.FILE_NAME, path) else [])]


def brute_notice(texts, bar=L.BAR, paths=None):
    """(license, score) of each text by comparing each part of every kind with each notice, without pruning."""
    known = [(name, words(t), 0) for name, t in L.TEMPLATES] + [(name, words(t), 1) for name, t in L.TEXTS]
    n = len(texts)
    df = collections.Counter(w for t in texts for w in set(words(t or "")))

    def vector(ws):
        v = {w: c * math.log((2 + n) / (1 + df[w])) for w, c in collections.Counter(ws).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}
    notices = [(name, set(ws), whole, vector(ws)) for name, ws, whole in known]
    out = []
    for path, t in zip(paths or ["-"] * n, texts):
        best = None
        for ws in {tuple(words(p)) for p in parts_of(path, t or "")}:
            v, own = vector(ws), set(ws)
            for name, its, whole, notice in notices:
                tells = set(L.KINDS if whole else L.MARKS)
                if own & tells != its & tells or not whole and its & set(L.NAMES) - own:
                    continue
                score = round(sum(x * notice.get(w, 0) for w, x in v.items()), 9)
                if score >= bar and (best is None or (whole, score, name) > best):
                    best = (whole, score, name)
        out.append((best[2], round(best[1], 6)) if best else None)
    return out


def test_query_against_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()
    got = L.op3_licenses(spark, SF_SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    own = {r.doc_id: (r.license, round(r.score, 6)) if r.evidence == "own" else None for r in got.collect()}
    want = {d.doc_id: x for d, x in zip(docs, brute_notice([d.text for d in docs]))}
    assert own == want and any(want.values())


def test_notices_in_running_text(spark):
    texts = ["Some prose. Licensed under CC BY-SA 4.0. More prose.", "the MIT licence of it", None, "", "Released under the mit license!\nx",
             "This work is licensed under the GNU General Public License, version 2.", "version of the work is public", "word " * 50_000]
    files = spark.createDataFrame([(f"/f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: (r.license, round(r.score, 6)) for r in L.notices(files).collect()}
    assert got == {f"/f{i}": x for i, x in enumerate(brute_notice(texts)) if x}
    assert got["/f0"][0] == "CC-BY-SA-4.0" and got["/f5"][0] == "GPL-2.0" and got["/f4"][0] == "MIT"


def test_what_tells_licences_apart(spark):
    """Versions, NC, ND, SA, Lesser and denials agree exactly; near prose is no notice."""
    filler = [d.text for d in table(spark, SF_SMALL, "documents").collect()]
    said = {"Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under CC BY 3.0.": "CC-BY-3.0",
            "Licensed under CC BY 2.5.": None, "This work is not licensed under the GNU General Public License, version 3.": None,
            "You may not use this road except in compliance with the law.": None, "Released under the MIT License.": "MIT",
            "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
            L._GNU.format("Lesser ", "2.1"): "LGPL-2.1", L._GNU.format("", 2): "GPL-2.0", "Licensed under the Apache License, Version 1.1.": None,
            "You may not use this file except in compliance with the License.": "Apache-2.0"}
    texts = [*said, *filler]
    files = spark.createDataFrame([(f"/f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: (r.license, round(r.score, 6)) for r in L.notices(files).collect()}
    assert [got.get(f"/f{i}", (None,))[0] for i in range(len(said))] == list(said.values())
    assert got == {f"/f{i}": x for i, x in enumerate(brute_notice(texts)) if x}


def test_parts_of_every_kind_against_brute_force(spark):
    gpl, mit, bsd = (dict(L.TEXTS)[x] for x in ("GPL-3.0", "MIT", "BSD-2-Clause"))
    wrapped = ["\n".join(textwrap.wrap(t, 50)) for t in (gpl, mit, bsd)]
    texts = ["/*\n * " + wrapped[0].replace("\n", "\n * ") + "\n */\nint x = 1;\n" * 3, "Some words.\n\n" + wrapped[1] + "\n\nOther words here.", wrapped[2],
             "import os\n# " + wrapped[1].replace("\n", "\n# ") + "\ncode()", "This work is licensed under the\nGNU General Public License,\nversion 3. More.", None, "",
             "Licensed under CC\nBY-SA 4.0. And so on", "; Released under the MIT License.\nmov ax, bx", "nothing of the kind"]
    paths = [f"/d{i}/{'LICENSE' if i in (2, 9) else 'x.c'}" for i in range(len(texts))]
    files = spark.createDataFrame(list(zip(paths, texts)), "path string, text string")
    got = {r.path: (r.license, round(r.score, 6)) for r in L.notices(files).collect()}
    want = {p: x for p, x in zip(paths, brute_notice(texts, paths=paths)) if x}
    assert got == want and len(want) >= 7


def test_common_words_weigh_little(spark):
    texts = ["unless noted otherwise somewhere by somebody"] * 300 + ["Released under the MIT License unless noted otherwise somewhere by somebody."]
    files = spark.createDataFrame([(f"/f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    assert [(r.path, r.license) for r in L.notices(files).collect()] == [("/f300", "MIT")]


def test_headers_files_and_identifiers(spark):
    gpl, bsd, mit = (dict(L.TEXTS)[x] for x in ("GPL-2.0", "BSD-3-Clause", "MIT"))

    def lines(t, mark=""):
        return "\n".join(f"{mark}{x}" for x in textwrap.wrap(t, 60))
    code = "int main() {\n  return compute(alpha, beta, gamma);\n}\n" * 30
    rows = [("/a/x.c", "/*\n * Copyright 2019 Somebody\n *\n" + lines(gpl, " * ") + "\n */\n" + code, "GPL-2.0"),
            ("/b/LICENSE", "Copyright (c) 2020, Somebody\n\n" + "\n\n".join(lines(x) for x in bsd.split(". ")), "BSD-3-Clause"),
            ("/c/x.py", lines(mit, "# ") + "\nimport os\n" + code, "MIT"),
            ("/d/x.py", "# SPDX-License-Identifier: GPL-3.0-or-later\n" + code, "GPL-3.0"),
            ("/e/x.js", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */\n" + code, "(MIT OR Apache-2.0)"),
            ("/g/x.md", "Some prose.\n\nThis work is licensed under the\nGNU General Public License,\nversion 3.\n\nMore prose, " + code, "GPL-3.0"),
            ("/h/x.c", code, None)]
    got = L.scan(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()
    assert {r.path: r.license for r in got} == {p: x for p, _, x in rows}


def test_nearest_ancestor(spark):
    rows = [("/a/LICENSE", "Released under the MIT License."), ("/a/b/x.c", "code"), ("/a/b/c/y.c", "// Licensed under CC BY-SA 4.0.\nfoo " + "bar " * 40),
            ("/z/q", None), ("/a/b/COPYING", "Copyright me. Licensed under the Apache License, Version 2.0. And a great many other words follow here"),
            ("/a/k", ""), ("/a/b/c/d/e/f", "hm"), ("/a/LICENSE", "repeated path"), ("top", "no directory")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("mine"))
    got = {r.path: (r.license, r.evidence, r.licensed_by) for r in L.scan(files.select("path", "text", "license")).collect()}
    assert got == {"/a/LICENSE": ("MIT", "own", None), "/a/b/x.c": ("Apache-2.0", "inherited", "/a/b"), "/a/b/c/y.c": ("CC-BY-SA-4.0", "own", None),
                   "/z/q": (None, None, None), "/a/b/COPYING": ("Apache-2.0", "own", None), "/a/k": ("MIT", "inherited", "/a"),
                   "/a/b/c/d/e/f": ("Apache-2.0", "inherited", "/a/b"), "top": (None, None, None)}
    assert L.scan(empty(files)).count() == 0


def test_awkward_documents(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = L.op3_licenses(spark, str(tmp_path)).collect()
    assert len(rows) == 9 and all(r.license is None for r in rows)
