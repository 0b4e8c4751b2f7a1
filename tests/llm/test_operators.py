"""The training-data operators on small tables with every odd row, against plain Python."""

import base64

import re
import zlib
from collections import Counter

import pytest
from conftest import TABLES
from pyspark.sql import functions as F

from lintlake.llm import (bpe, chat_format, exact_dedup, lang_id, license_scan, lm_mixing, ngram_join, pii_feistel, quality_votes, queries,
                          source_mix)

LONG = "word " * 30_000
ODD = [(0, None, None), (1, "", "a"), (2, " \n\t", "a"), (3, "One two", None), (4, "one TWO", "b"), (5, "Äpfel one two three four five six", "b"),
       (6, LONG, "c"), (7, LONG.upper(), "c"), (8, "😀 ½ x", "c"), (8, "😀 ½ x", "c"), (None, "no id", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({"n": F.lit(1), "id": F.lit("x"), "size": F.lit(0), "digest": F.lit(0)})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_bpe_equals_the_library(odd):
    tiktoken, names = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.ranks_path(), "rb"))}
    own = tiktoken.Encoding("own", pat_str=names.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(odd, queries.ranks_path())
    assert [(r["doc_id"], r["ids"]) for r in coded.collect()] == [(i, own.encode_ordinary(t or "")) for i, t, _ in ODD]
    back = bpe.decode(coded, queries.ranks_path()).collect()
    assert [bytes(r["decoded"]) for r in back] == [(t or "").encode() for _, t, _ in ODD]
    assert bpe.encode(odd.limit(0), queries.ranks_path()).count() == 0


def test_minimal_perfect_hash_is_minimal():
    _, v = bpe.load(queries.ranks_path())
    assert sorted(v.slot_rank.tolist()) == list(range(v.size)) and v.n_keys == v.size


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(odd, weak):
    digest = (lambda t: F.substring(exact_dedup.digest(t), 1, 1)) if weak else exact_dedup.digest
    got = exact_dedup.dedup(odd, digest_of=digest, max_bytes_per_trigger=1).collect()
    groups = {}
    for i, t, _ in ODD:
        groups.setdefault(folded(t), []).append(i)
    want = sorted(((-1 if i is None else i), max((-1 if x is None else x) for x in groups[folded(t)]), len(groups[folded(t)])) for i, t, _ in ODD)
    assert sorted((-1 if r["id"] is None else r["id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.survivors(odd).count() == len(groups)


def test_state_goes_on(spark, tmp_path):
    """A second run of the stream finds what the first one has kept."""
    made = lambda ids: exact_dedup.records(exact_dedup.located(spark.createDataFrame([(i, "same") for i in ids], "doc_id long, text string")), "doc_id", "text", exact_dedup.digest)
    rows = str(tmp_path / "rows")
    for ids in ([1, 2], [3]):
        made(ids).write.mode("append").parquet(rows)
        exact_dedup.update_state(spark.readStream.schema(made(ids).schema).parquet(rows), str(tmp_path / "state"))
    assert [(r["stay"]["id"], r["n"]) for r in exact_dedup.read_state(spark, str(tmp_path / "state")).collect()] == [(3, 3)]


def test_exact_dedup_of_a_partitioned_table(spark, tmp_path):
    """The files of partition folders share their base names."""
    rows = [(i, f"text {i // 2}", f"l{i % 2}") for i in range(12)] + [(100 + i, f"only l{i % 2} {i}", f"l{i % 2}") for i in range(6)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.partitionBy("lang").parquet(path)
    docs = spark.read.parquet(path)
    assert len({f.rsplit("/", 1)[1] for f in docs.inputFiles()}) == 1 < len(docs.inputFiles())
    got = exact_dedup.dedup(docs).collect()
    want = [(i, i | 1, 2, i % 2 == 1) for i in range(12)] + [(100 + i, 100 + i, 1, True) for i in range(6)]
    assert sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    assert sorted(r["doc_id"] for r in exact_dedup.survivors(docs).collect()) == [w[0] for w in want if w[3]]


def components(rows, n, percent):
    sets, parent = [], {}
    for i, t in rows:
        w = split(folded(t))
        sets.append((i, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
        parent[i] = i

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for k, (i, s) in enumerate(sets):
        for j, r in sets[:k]:
            if s and r and 100 * len(s & r) >= percent * len(s | r):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (2, 80), (1, 100)])
def test_jaccard_join(spark, n, percent, monkeypatch):
    import random

    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    rnd, rows = random.Random(n), [(i, t) for i, t, _ in ODD[:8]]
    base = [[rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.choice([2, 5, 11, 30, 80]))] for _ in range(12)]
    for i in range(100, 400):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice("xyz")
        rows.append((i, " ".join(w)))
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent).collect()
    assert {r["id"]: (r["n_elements"], r["component"]) for r in got} == components(rows, n, percent)


def test_source_mix(spark, odd):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 4}" if i % 9 else None) for i in range(4000)]
    found = source_mix.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(found) == 4000 and (found["taken"] <= 3 * found["size"]).all()
    for _, g in found.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) < 0.03 * g["target"].iloc[0]
    assert abs(found.drop_duplicates("source")["target"].sum() - found["size"].sum()) < 1e-6
    small = source_mix.report(odd)
    assert small.count() == len(ODD) and small.filter("taken > 3 * size").count() == 0
    assert source_mix.report(odd.limit(0)).count() == 0
    assert source_mix.mixed(odd).columns == odd.columns


def test_quality_measures(odd):
    got = {r["doc_id"]: r["m"] for r in odd.dropDuplicates(["doc_id"]).select("doc_id", quality_votes.measures(F.col("text")).alias("m")).collect()}
    for i, t, _ in ODD:
        w, t = split(t), t or ""
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        seen, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            covered |= set(range(k, k + 5)) if seen[g] > 1 else set()
        m = got[i]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(covered))
    assert {r["doc_id"] for r in quality_votes.keep_good(odd).collect()} <= {i for i, _, _ in ODD}
    assert quality_votes.keep_good(odd.limit(0)).count() == 0


def test_language_by_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = lang_id.fit(docs.filter(~lang_id.held_out(F.col("doc_id"))))
    told = lang_id.predict(docs.filter(lang_id.held_out(F.col("doc_id"))), model)
    right = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    odd = lang_id.predict(spark.createDataFrame([(1, None), (2, ""), (3, "1 ½ _ 😀"), (4, "the")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in odd][:3] == ["und"] * 3 and odd[3]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in odd)
    nothing = lang_id.fit(docs.limit(0))
    assert lang_id.predict(docs.limit(1), nothing).first()["lang_pred"] == "und"


def test_unigram_base_and_model(odd):
    rows = [(i, folded(t).encode().split() + [None]) for i, t, _ in ODD if i is not None]
    seen = Counter()
    for i, w in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update(w)
    got = lm_mixing.scores(odd.filter("doc_id is not null")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = next(w for i, w in rows if i == r["doc_id"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(seen[x] > 0 for x in w), sum(seen.values()))
        assert r["score"] < 0
    assert lm_mixing.scores(odd.limit(0)).count() == 0


def test_bit_predictions_add_up():
    """Over all bytes that can follow a text, the model's probabilities add up to one."""
    import numpy as np

    cells = [16 * s for s in lm_mixing.SLOTS] + [256 * s for s in lm_mixing.ESCAPED]
    tables = [np.random.default_rng(1).integers(-99, 99, n).astype(np.int8) for n in cells]
    score = lambda t: lm_mixing._bit_scores([lm_mixing.PAD + t], tables, lm_mixing._start())[0]
    total = sum(2 ** (score(b"ab" + bytes([c])) - score(b"ab")) for c in range(256))
    assert abs(total - 1) < 1e-3


def test_chat_round_trip(spark):
    import random

    rnd, pieces = random.Random(2), ["<", "|im_start|>", "|im_end|>", "\\", "s>", "/s>", "[", "INST]", "<SYS>>", "\n", "é🙂", "<|im_end|>\n"]
    rows = [(i, [(rnd.choice(["user", "assistant", "x\n\\n<s>", ""]), "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9)))) for _ in range(rnd.randint(0, 4))])
            for i in range(500)]
    df = spark.createDataFrame(rows, "id long, turns array<struct<role:string,text:string>>")
    out = df.select("turns", chat_format.formatted(F.col("turns")).alias("f")).select("*", chat_format.read_back(F.col("f.text"), F.col("f.loss")).alias("b"))
    for r in out.collect():
        assert r["turns"] == r["b"]["turns"]
        assert r["b"]["loss_text"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    records = [(1, '{"prompt":"a","response":null}'), (2, '{"conversations":[{"from":"human","value":"x"}]}'), (3, '{"foo":1}'), (4, "no JSON"), (5, None)]
    mapped = chat_format.canonical(spark.createDataFrame(records, "id long, record string"))
    assert [r["layout"] for r in mapped.collect()] == [0, 3, None, None, None] and chat_format.unmatched(mapped).count() == 3


def test_chat_texts_that_are_json(spark, tmp_path, monkeypatch):
    texts = ['[{"city":"Paris"}]', '[{"city":"Paris"}] and more', '{"a":[{"b":1}]}', '["x"]', "[[{}]]", "[", '"quoted"', "7", "null", ""]
    chats = [[(role, t) for role in roles] for t in texts for roles in (["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["assistant"])]
    rows = [(i, n, role, t) for i, chat in enumerate(chats) for n, (role, t) in enumerate(chat)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    held = spark.read.parquet(str(tmp_path / "conversations.parquet"))
    turns = chat_format.canonical(chat_format.records_from_turns(held), texts="texts")
    assert {r["conv_id"]: r["turns"] for r in turns.collect()} == dict(enumerate(chats))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in queries.op6_chat_formatting(spark, str(tmp_path)).collect() if r["conv_id"] >= 0}
    assert got == {i: (len(c), sum(len(t) for role, t in c if role == "assistant")) for i, c in enumerate(chats)}
    mixed = [(1, '{"messages":[{"role":"user","content":"[{}]"}],"id":"7"}'), (2, '{"messages":"[{\\"role\\":1,\\"content\\":2}]"}'), (3, '{"id":7,"messages":[{"role":"user"},{"content":"x"}]}')]
    paths = spark.createDataFrame(mixed, "i long, record string").select(chat_format.field_paths(F.col("record")).alias("p")).collect()
    assert [r["p"] for r in paths] == [["id", "messages", "messages[].content", "messages[].role"], ["messages"], ["id", "messages", "messages[].content", "messages[].role"]]
    records = chat_format.records_from_turns
    monkeypatch.setattr(chat_format, "records_from_turns", lambda df: records(df).withColumn(
        "record", F.when(F.col("conv_id") == 3, '{"foo":1}').otherwise(F.col("record"))))
    rest = queries.op6_chat_formatting(spark, str(tmp_path)).collect()
    assert {r["conv_id"] for r in rest} == {-7, *range(len(chats))} and [r["conv_id"] for r in rest if r["layout"] is None] == [3]
    assert all((r["n_turns"] is None) == (r["conv_id"] == 3) for r in rest)


def test_pseudonyms(spark):
    texts = ["a tom.72@mail8.example.com, +1 (202) 555-1015; 4000 0389 8569 3383 x 12.27.139.170. 2021-02-28 12/31/1999 123-45-6789", "4000038985693383",
             "999.1.1.1 2021-02-30 1234567890123456", None, "", "é 🙂"]
    out = pii_feistel.apply(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "k")
    rows = out.select("*", pii_feistel.pseudonymise(F.col("text"), "k", back=True)["text"].alias("back")).collect()
    assert [r["back"] for r in rows] == texts
    assert [r["text"] for r in rows][2:] == texts[2:]
    assert rows[0]["pii_kinds"] == ["email", "phone", "card", "ip", "date", "date", "ssn"]
    assert rows[1]["text"] in rows[0]["text"].replace(" ", "")
    # Octets may be of one to three digits; all else keeps its length.
    form = lambda t: re.sub(r"9+(\.9+){3}", "ip", re.sub("[0-9]", "9", re.sub("[a-z]", "a", t)))
    assert form(rows[0]["text"]) == form(texts[0])


def test_pseudonyms_of_other_formats(spark):
    import datetime

    phones = ["(202) 555-0143", "202-555-0143", "1-202-555-0143", "+1 202 555 0143", "202.555.0143", "+49 30 1234567", "+44 (0)20 7946 0958", "+33612345678"]
    dates = ["31.12.2024", "31/12/2024", "1/2/2024", "2024/12/31", "1.2.2024", "31/1/2024", "29/02/2024", "2/29/2024", "29.2.2000", "12/5/1999"]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NO9386011117947"]
    wrong = ["DE88 3704 0044 0532 0130 00", "32/13/2024", "30.02.2024", "29/02/2023", "2024/13/01", "2/29/2023", "1.2.2024.5", "+49 1234"]
    values = phones + dates + ibans
    texts = [f"a {v}, b" for v in values + wrong] + ["; ".join(values)]
    out = pii_feistel.apply(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "k").localCheckpoint()
    rows = sorted(out.select("*", pii_feistel.pseudonymise(F.col("text"), "k", back=True)["text"].alias("back")).collect())
    assert [r["back"] for r in rows] == texts
    kinds = ["phone"] * len(phones) + ["date"] * len(dates) + ["iban"] * len(ibans)
    assert rows[-1]["pii_kinds"] == kinds and [r["pii_kinds"] for r in rows[:-1]] == [[k] for k in kinds] + [[]] * len(wrong)
    got = [r["text"][2:-3] for r in rows[:-1]]
    assert got[len(values):] == wrong and all(a != b for a, b in zip(got, values)) and "; ".join(got[:len(values)]) == rows[-1]["text"]
    assert len({re.sub("[^0-9]", "", p)[-10:] for p in got[:5]}) == 1 and got[5].startswith("+49 ") and got[7].startswith("+33")
    for v, form in zip(got[len(phones):], ("%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%m/%d/%Y")):
        datetime.datetime.strptime(v, form)
    for v in got[-len(wrong) - len(ibans):-len(wrong)]:
        v = v.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_feistel_is_a_permutation(spark):
    n = spark.range(898 * 9)
    one = lambda v: F.lit(v).cast("bigint")
    moved = n.select(pii_feistel.feistel(F.col("id"), one(9), one(898), "k", F.lit("t")).alias("x"))
    assert moved.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()[:] == (898 * 9, 0, 898 * 9 - 1)


def test_licences(spark, odd):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, next(t for _, t in license_scan.TEMPLATES if t.startswith("Permission is hereby")).replace(" ", "\n", 3)), (3, "no licence here"), (4, None)]
    got = {r["doc_id"]: [(m["unit"], m["licence"]) for m in r["licences"]] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The line, the short paragraph around it, which is still similar enough, and the sentence that began on the line before.
    assert got[1] == [(1, "Apache-2.0"), (3, "Apache-2.0"), (4, "Apache-2.0")] and got[3] == got[4] == [] and ("MIT" in {x for _, x in got[2]})
    assert license_scan.scan(odd).count() == len(ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    import duckdb
    import pandas as pd

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.ORACLES[name]).df()
    plain = lambda df: list(tuple(None if pd.isna(v) else (float(v) if isinstance(v, (int, float)) else str(v)) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(map(repr, plain(ours))) == sorted(map(repr, plain(theirs)))


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    single = corpus_pipeline.near_copies(spark, docs, folder)
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {c for _, c in want.values()}
    coded = corpus_pipeline.encode(spark, corpus_pipeline.mix(spark, docs, folder), folder)
    assert coded.agg(F.min("round_trip")).first()[0]
