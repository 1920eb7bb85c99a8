"""License scan against SQL that compares every block with every template."""

import random

import duckdb
import pandas as pd

from ledgerlens.llm import license_scan

FILL = "lorem ipsum dolor sit amet consectetur "
TEXTS = [
    None,
    "",
    "  ...  ",
    "Released under the MIT License.",
    "cc by nc cc-by-nc CC BY NC",
    FILL * 30 + "Licensed under the Apache License, Version 2.0." + FILL * 30 + "under the mit license",
    "under the mit under the mit license",
    "This work is licensed\nunder the GNU General\nPublic License, version 3.",
    "This work was licensed under GNU General Public License, version 3",
    "all rights  reserved", "all rights", "ÄPACHE apache license version 2ü apache license version 2",
    FILL * 2000 + "Redistribution and use in source and binary forms, with or without modification, are permitted",
    (FILL * 5 + "permission is hereby granted, free of charge, to any person obtaining a copy of this software ") * 3,
    "nc 4 0 licensed by under cc", "licensed under cc by nc",
]


def compared(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, labels int")
    found = license_scan.scan(df)
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    duck = duckdb.connect()
    duck.register("documents", documents)
    result = duck.execute(license_scan.scan_sql())
    names = [d[0] for d in result.description]
    key = lambda r: (str(r[0]), str(r))
    ours = sorted((tuple(r) for r in found.select(*names).collect()), key=key)
    theirs = sorted((tuple(None if v != v else v for v in r) for r in result.fetchall()), key=key)
    return ours, theirs


def test_scan_equals_brute_force(spark):
    ours, theirs = compared(spark, list(enumerate(TEXTS)))
    assert ours == theirs
    by_id = {r[0]: r for r in ours}
    assert by_id[4][2] == 3 and by_id[0][1] == 0
    assert "mit" in by_id[3] and "gpl-3" in by_id[7] and "gpl-3" in by_id[8] and "bsd" in by_id[12]


def test_a_match_does_not_depend_on_where_the_notice_stands(spark):
    notice = "Permission is granted, free of charge, to any person obtaining a copy of this software"
    rows = [(i, "lorem " * i + notice + " ipsum" * 40) for i in range(70)]
    assert {r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {"mit"}


def test_words_that_tell_licenses_apart_must_be_there(spark):
    texts = {
        "Dies ist eine Lizenz under license permission mit the free Software": "",
        "Ein Text mit Licensed under the Apache License, Version 2.0.": "apache-2",
        "Licensed under CC BY 4.0": "",
        "Licensed under CC BY-NC 4.0": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 2": "",
        "This work is licensed under the GNU General Public License, version 3": "gpl-3",
        "released under " + "lorem " * 20 + "the mit license": "",
        "Released under MIT license": "mit",
        "all rights are reserved": "all-rights-reserved",
    }
    rows = list(enumerate(texts))
    ours, theirs = compared(spark, rows)
    assert ours == theirs
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in found} == dict(enumerate(texts.values()))


def test_shuffled_notices_equal_brute_force(spark):
    draw, rows = random.Random(3), []
    for i in range(300):
        words = draw.choice(license_scan.TEMPLATES)[1].split() + draw.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(draw.randrange(6)):
            words[draw.randrange(len(words))] = draw.choice(["lorem", "the", "mit", "license", "3", words[0]])
        if i % 3 == 0:
            draw.shuffle(words)
        rows.append((i, " ".join(words)))
    ours, theirs = compared(spark, rows)
    assert ours == theirs and sum("," in r for row in ours for r in row if isinstance(r, str)) > 20


def test_very_long_text(spark):
    text = FILL * 40_000 + "All rights reserved. " * 3 + FILL * 40_000 + "Released under the MIT License"
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["labels"]) == (480_014, "all-rights-reserved,mit")


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, TEXTS[3]), (1, TEXTS[3]), (1, TEXTS[9]), (None, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["labels"]) for r in license_scan.scan(df).collect()]
    assert sorted(found, key=str) == sorted([(1, "mit"), (1, "mit"), (1, "all-rights-reserved"), (None, "mit")], key=str)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = license_scan.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
