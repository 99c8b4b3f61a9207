"""Notices with a word missing or inserted, against every place tried by brute force."""

from graphloom.llm.license_scan import K, NOTICES, scan_licenses


def test_notices_with_a_missing_or_inserted_word(spark):
    rows, want = [], {}
    for t in NOTICES:
        w = t.words()
        size = len(w) - K + 1
        for i in range(1, len(w) - 1):
            for changed, lost in ((w[:i] + w[i + 1 :], 2), (w[:i] + ["zzz"] + w[i:], 1)):
                n = len(rows)
                rows.append((n, " ".join(["before", *changed, "after"])))
                want[n] = (t.label, (size - lost) / size)
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), NOTICES).collect()}
    assert len(got) == len(rows)
    for n, (label, share) in want.items():
        if share >= 0.8:
            assert label in got[n]["labels"].split(",") and got[n]["score"] >= share - 1e-9, rows[n]


def test_mit_notice_without_its_eleventh_word(spark):
    w = NOTICES[1].words()
    row = scan_licenses(spark.createDataFrame([(1, " ".join(w[:10] + w[11:]))], "doc_id long, text string")).first()
    assert row["labels"] == "mit" and abs(row["score"] - 17 / 19) < 1e-9
