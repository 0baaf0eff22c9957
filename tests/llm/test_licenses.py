import re

from odd_rows import ROWS, clashing, folder, table

from lacuna.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for p, label in L.PHRASES.items() for k in [p.split()] for i in range(len(words)) if words[i : i + len(k)] == k)
    at = [i for i, _ in places]
    return len(words), len(places), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


MORE = [
    (20, "MIT License. Mit license mit license; APACHE license!", "en", "a"),
    (21, "the GNU General, Public License\nand CC-BY", "en", "a"),
    (22, "GNU Lesser General Public License", "en", "a"),
    (23, "mit Licenſe and MİT license and the MIT-License and K", "en", "a"),
    (24, "Permission is hereby granted, free of charge, to any (other) person obtaining a copy of this thing", "en", "a"),
    (25, "license mit", "en", "a"),
    (26, None, "en", "a"),
]


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_odd_rows(spark, tmp_path):
    rows = L.op6_license_scans(spark, folder(clashing(table(spark, ROWS + MORE)), tmp_path)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=key)
    assert got == sorted(((i, *plain(t)) for i, t, *_ in ROWS + MORE), key=key)
    by = {r.doc_id: r for r in rows}
    assert by[22].labels == "lgpl" and by[22].n_base == 0 and by[24].labels == "mit" and 0.8 <= by[24].score < 1
    assert by[20].labels == "apache,mit" and by[20].score == 1 and by[26].score == 0 and by[25].labels == ""


def test_empty_table(spark, tmp_path):
    assert L.op6_license_scans(spark, folder(table(spark, []), tmp_path)).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = L.op6_license_scans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan.split("== Physical Plan ==")[1])
