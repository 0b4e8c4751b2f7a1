"""Registered queries, run over whole tables, against plain Python."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_queries import plain

from lintlake.llm import queries


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()


def words(text):
    """A letter, then letters and marks."""
    found, now = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and now):
            now += c
        elif now:
            found.append(now)
            now = ""
    return found


def test_language_id(spark, docs):
    learned = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 and d["text"] is not None and d["lang"] is not None]
    assert len(learned) < 5000  # so all of them are learned from
    seen, grams = Counter(), Counter()
    for d in learned:
        for w in words(d["text"]):
            seen[d["lang"], w] += 1
    for (lang, w), n in seen.items():
        for k in range(1, 6):
            for i in range(len(w) + 3 - k):
                grams[k, lang, f"_{w}_"[i:i + k]] += n
    langs = sorted({lang for lang, _ in seen})
    vocabulary = {w for _, w in seen}
    known = [{g for k, _, g in grams if k == n} for n in range(6)]
    total = {lang: sum(n for (x, _), n in seen.items() if x == lang) + 0.1 * (len(vocabulary) + 1) for lang in langs}
    sums = {(k, lang): sum(n for (a, x, _), n in grams.items() if (a, x) == (k, lang)) + 0.1 * (len(known[k]) + 1) for k in range(1, 6) for lang in langs}

    def of_word(w, lang):
        if w in vocabulary:
            return math.log((seen[lang, w] + 0.1) / total[lang])
        for k in range(5, 0, -1):
            hits = [g for g in (f"_{w}_"[i:i + k] for i in range(len(w) + 3 - k)) if g in known[k]]
            if hits:
                return sum(math.log((grams[k, lang, g] + 0.1) / sums[k, lang]) for g in hits) / len(hits)
        return 0.0

    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, mine = got[d["doc_id"]], Counter(words(d["text"]))
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        if not mine:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        scores = {lang: sum(n * of_word(w, lang) for w, n in mine.items()) for lang in langs}
        best = max(scores.values())
        assert scores[r["lang_pred"]] >= best - 1e-3 * (1 + abs(best))
        assert r["score"] == pytest.approx(1 / sum(math.exp(max(-700, s - best)) for s in scores.values()), abs=1e-2)


def test_lm_base_score(spark, docs):
    tokens = {d["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", folded(d["text"])), None] for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    seen = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(seen.values()), len(seen)
    rows = queries.op3_lm_scoring(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ts = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ts), sum(seen[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
        assert r["score"] < 0


def test_language_id_of_marks_long_texts_and_clashing_columns(spark):
    from lintlake.llm import lang_id

    rows = [(1, "the cat", "en", 5.0, "x"), (2, "die Katze", "de", 5.0, "x"), (3, "แมวอยู่ที่นี่", "th", 5.0, "x"), (None, "the", "en", 5.0, "x"), (4, "the dog " * 200_000, "en", 5.0, "x"),
            (5, "́̂", "en", 5.0, "x"), (5, "́̂", "en", 5.0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    told = lang_id.predict(df, lang_id.fit(df.filter("coalesce(doc_id, 0) != 4")))
    assert len(lang_id.fit(df.filter("doc_id = 4")).words) == 2
    assert sorted(told.columns) == ["doc_id", "lang", "lang_pred", "score"]
    got = told.collect()
    assert len(got) == 7 and all(r["lang_pred"] == (r["lang"] if r["doc_id"] != 5 else "und") and 0 <= r["score"] <= 1 for r in got)
    assert lang_id.words_of("แมวอยู่ที่นี่") == ["แมวอยู่ที่นี่"] and lang_id.words_of("Ⅷ ½ 7") == []


def test_licence_versions_and_sentences(spark, tmp_path):
    from lintlake.llm import license_scan

    texts = {t: {name} for name, t in license_scan.TEMPLATES}  # each template's text goes to its own licence
    texts |= {
        "This work is licensed under the GNU General Public License, version 2": {"GPL-2.0"},
        "See the site. Released under the MIT License. Ask us for more! ": {"MIT"},
        "Docs: licensed under CC BY-SA 4.0. This work is licensed under the GNU Lesser General Public License, version 2.1. x": {"CC-BY-SA-4.0", "LGPL-2.1"},
        "Released under the MIT License.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": {"MIT", "BSD"},
        # Notices in comment blocks, wrapped, among other sentences.
        "// Copyright (c) 2020 A. Body\n//\n// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n"
        "// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\n//\n//\n// It is of use.\nint main;": {"GPL-3.0"},
        "/*\n * Tool for x. Copyright B. Other. This Source Code Form is subject to the\n * terms of the Mozilla Public License, v. 2.0. More on x. This work is licensed under a Creative\n"
        " * Commons Attribution 4.0 International License. Enough.\n */": {"CC-BY-4.0"},
        "# MIT License\n#\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software "
        "without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n# copies of the Software, and to permit persons to whom "
        "the Software is\n# furnished to do so, subject to the following conditions:\n#\n# The above copyright notice and this permission notice shall be included in all\n# copies": {"MIT"},
        "We ship x. Redistributions of source code must retain\r\nthe above copyright notice, this list of conditions and the following\r\ndisclaimer. Bye": {"BSD"},
        "Permission to\nenter. No\nredistribution. -\n-\n": set(), "\n//\n//\n \n": set(),
        "A licence. Or a license! Not one; none?  ": set(), "license. ": set(), "": set(),
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df.withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert plain(queries.op2_license_scan(spark, str(tmp_path)).toPandas()) == plain(con.execute(queries.ORACLES["op2_license_scan"]).df())
    for r in license_scan.scan(df.withColumn("t", df["text"])).collect():
        assert {m["licence"] for m in r["licences"]} == texts[r["t"]], r["t"]
