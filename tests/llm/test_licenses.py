import re

from snaplake.llm import licenses as li

PYTHON = re.compile("Python|Pandas|Arrow")


def test_own_and_inherited(workers):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\nMore."),
        (2, "a/b/c/x.py", "no notice"),
        (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0 (the thing)\ncode"),
        (4, "a/b/c/d/z.py", None),
        (5, "q/r.py", "license plates are metal"),
        (6, "top.py", "This work is licensed under the GNU General Public License, version 3."),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, "a/b/y.py", "nothing"),
        (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0 (the thing)\ncode"),
        (None, "a/k.py", ""),
    ]
    files = workers.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, path string, text string, license string, above string")
    out = li.scan(files)
    got = sorted(((r.doc_id, r.path, r.own_license, r.license, r.inherited_from) for r in out.collect()), key=repr)
    assert got == sorted(
        [
            (1, "a/LICENSE", "MIT", "MIT", None),
            (2, "a/b/c/x.py", None, "Apache-2.0", "a/b"),
            (3, "a/b/y.py", "Apache-2.0", "Apache-2.0", None),
            (3, "a/b/y.py", "Apache-2.0", "Apache-2.0", None),
            (4, "a/b/c/d/z.py", None, "Apache-2.0", "a/b"),
            (5, "q/r.py", None, None, None),
            (6, "top.py", "GPL-3.0", "GPL-3.0", None),
            (7, None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
            (8, "a/b/y.py", None, "Apache-2.0", "a/b"),
            (None, "a/k.py", None, "MIT", "a"),
        ],
        key=repr,
    )
    assert not PYTHON.search(out._jdf.queryExecution().executedPlan().toString())


def test_no_files_and_no_notices(workers):
    empty = workers.createDataFrame([], "doc_id long, path string, text string")
    assert li.scan(empty).count() == 0
    plain = workers.createDataFrame([(1, "a/b", "text")], "doc_id long, path string, text string")
    assert [(r.license, r.similarity) for r in li.scan(plain).collect()] == [(None, None)]
