"""Inputs that once lost or changed data: very long texts, words made to collide, small sources."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake.llm import bpe, chat_format, ngram_join, queries, source_mix


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


TWINS = ["q" * 16 + thue_morse(2048), "q" * 16 + thue_morse(2048, "b", "a")]


def test_texts_beyond_the_limit_of_json_strings(spark, tmp_path):
    long = F.repeat(F.lit("abcdefg"), 3_000_000)
    rows = spark.range(2).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.when(F.col("id") == 0, F.lit("short")).otherwise(long).alias("text"))
    four = spark.range(4).select(F.lit(2).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.when(F.col("id") == 1, long).otherwise(F.lit("x")).alias("text"))
    rows.unionByName(four).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op6_chat_formatting(spark, str(tmp_path)).collect()}
    assert {i: (r["n_turns"], r["loss_chars"], r["layout"]) for i, r in got.items()} == {-7: (2, 21, 0), 1: (2, 21_000_000, 0), 2: (4, 21_000_001, 2)}
    # Inside a record such a text can't be read: the record is put aside, never emptied.
    record = F.concat(F.lit('{"prompt":"short","response":"'), long, F.lit('"}'))
    aside = chat_format.canonical(spark.range(1).select(record.alias("record"))).select("layout", "turns").first()
    assert aside["layout"] is None and aside["turns"] is None


def test_conversations_of_other_shapes(spark):
    rows = [(1, 0, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("t", "record", "texts", "layout", "turns", "f", "_print")})
    got = chat_format.canonical(chat_format.records_from_turns(df), texts="texts").collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got} == {1: [("", "")], 2: [("user", "a"), ("user", "a"), ("assistant", "b")], None: [("user", "x")]}
    assert chat_format.canonical(chat_format.records_from_turns(df.limit(0)), texts="texts").count() == 0


def test_words_made_to_collide(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TWINS)], "doc_id long, text string").coalesce(1)
    coded = bpe.encode(docs, queries.ranks_path())
    assert [bytes(r["decoded"]).decode() for r in bpe.decode(coded, queries.ranks_path()).orderBy("doc_id").collect()] == TWINS
    assert {r["component"] for r in ngram_join.similar(docs, n=3, percent=90).collect()} == {0, 1}


def test_ids_equal_the_librarys_on_random_bytes(spark):
    tiktoken, names = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.ranks_path(), "rb"))}
    own = tiktoken.Encoding("own", pat_str=names.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abq é\n\t 12'sß中🙂\u2003.") for _ in range(rnd.randrange(400))) for _ in range(300)]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.ranks_path()).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: own.encode_ordinary(t) for i, t in enumerate(texts)}


def links_by_hand(rows, n, percent):
    def grams(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [(i, grams(t)) for i, t in rows]
    links = {k: [m for m, (_, b) in enumerate(sets) if m != k and a and b and 100 * len(a & b) >= percent * len(a | b)] for k, (_, a) in enumerate(sets)}
    out = []
    for k, (i, a) in enumerate(sets):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((i, len(a), min(sets[m][0] for m in seen), len(links[k])))
    return sorted(out)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 100), (2, 50)])
def test_links_and_their_counts(spark, n, percent):
    rnd = random.Random(n)
    base = [[f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 120))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(30)}"
        rows.append((i, " ".join(w) if rnd.random() < .7 else "\n".join(w).upper()))
    # Equal sets in another order of words, texts without words, fewer words than n.
    rows += [(200, "a b c a b c a"), (201, "b c a b c a b"), (202, ""), (203, None), (204, " \t"), (205, "x"), (206, "X"), (207, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("id", "class", "g", "n", "copies", "rep", "component")})
    got = sorted(tuple(r) for r in ngram_join.similar(df, n=n, percent=percent).collect())
    assert got == links_by_hand(rows, n, percent)
    assert ngram_join.similar(df.limit(0), n=n, percent=percent).count() == 0
    null = ngram_join.similar(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r["component"] or 0, r["n_links"]) for r in null) == [(0, 0), (1, 1), (1, 1)]


def shares_by_hand(sizes, weights, most=3):
    capped, total = set(), sum(sizes.values())
    while True:
        free = total - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else free * weights[s] / w for s in sizes}
        over = {s for s in sizes if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_small_sources_reach_their_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {"a": 300_000, "b": 20, "c": 65, "d": 90, "e": 130, "f": 1, "g": 64, "h": 7_001, None: 3}
    rows = []
    for s, n in sizes.items():
        while n:
            k = min(n, rnd.randrange(1, 400))
            rows.append((len(rows), s, "w " * k))
            n -= k
    rows += [(len(rows), "b", None), (len(rows) + 1, "new", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = source_mix.report(df).collect()
    order = sorted(s for s in {r[1] for r in rows} if s) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = shares_by_hand(sizes, {s: weights[s] for s in sizes})
    taken = dict.fromkeys(target, 0)
    for r in got:
        assert r["size"] == len(rows[r["id"]][2] or "") // 2 and r["taken"] <= 3 * r["size"] and r["source_size"] == sizes.get(r["source"], 0)
        assert abs(r["target"] - target.get(r["source"], 0)) < 1e-6
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(got) == len(rows)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 33, (s, t, taken[s])
    again = {(r["id"], r["taken"]) for r in source_mix.report(df.repartition(5)).collect()}
    assert again == {(r["id"], r["taken"]) for r in got}
    assert source_mix.mixed(df.filter("source = 'b'")).count() >= 1


def test_every_stretch_of_the_schedule_is_mixed(spark):
    plan = spark.createDataFrame([("a", 64_000, 64_000.0), ("b", 32_000, 32_000.0), ("c", 6_400, 6_400.0)], "source string, source_size long, target double")
    slots = [r["source"] for r in source_mix.schedule(plan).orderBy("slot").collect()]
    assert [slots.count(s) for s in "abc"] == [1000, 500, 100]
    for at in range(0, 1400, 200):
        assert abs(slots[at:at + 200].count("a") - 125) <= 5 and abs(slots[at:at + 200].count("c") - 12.5) <= 5


def test_pseudonyms_keep_capitals_and_permute_single_symbols(spark):
    from lintlake.llm import pii_feistel

    texts = ["Tom.X@Mail.com", "tom.x@mail.com", "TOM.X@mail.com", *[f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"], *[f"{c}@y.org" for c in "0123456789"],
             *[f"29/2/{y}" for y in range(1704, 2097, 4) if y % 100], "A1b@q.de", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"_p": F.lit(1), "pii_kinds": F.lit("x")})

    def moved(key):
        out = pii_feistel.apply(df, key)
        rows = out.select("doc_id", "text", pii_feistel.pseudonymise(F.col("text"), key, back=True)["text"].alias("back")).orderBy("doc_id").collect()
        assert [r["back"] for r in rows] == texts
        return [r["text"] for r in rows], out

    one, out = moved("k1")
    assert [[c.isupper() for c in t.split("@")[0]] for t in one[:3]] == [[c.isupper() for c in t.split("@")[0]] for t in texts[:3]]
    assert one[0].split("@")[0].lower() == one[1].split("@")[0] == one[2].split("@")[0].lower()
    letters = [t[0] for t in one[3:29]]
    assert sorted(letters) == list("abcdefghijklmnopqrstuvwxyz") and len({(ord(a) - i) % 26 for i, a in enumerate(letters)}) > 3
    assert sorted(t[0] for t in one[29:39]) == list("0123456789")
    leap = [int(t[-4:]) for t in one[39:39 + len([t for t in texts if t and t.startswith("29/2/")])]]
    assert len(set(leap)) == len(leap) and len({b - int(t[-4:]) for b, t in zip(leap, texts[39:], strict=False)}) > 10
    two, _ = moved("k2")
    assert two != one
    plan = out._jdf.queryExecution().toString()
    assert "k1" not in plan.replace(pii_feistel._subkey("k1", "pseudonym"), "").replace(pii_feistel._subkey("k1", "abroad"), "")
    assert pii_feistel.apply(df.limit(0), "k").count() == 0


def test_quality_of_odd_rows(spark):
    from lintlake.llm import quality_votes

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.withColumns({"_measures": F.lit(1), "kept": F.lit("x")})
    kept = quality_votes.keep_good(odd)
    want = {r["doc_id"] for r in queries.op8_quality_rules(spark, "/root/testdata/sf0.001").collect() if r["kept"]}
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == want and 0 < len(want) < docs.count()
    assert quality_votes.keep_good(odd.limit(0)).count() == 0


def posterior_by_hand(rows, names):
    """EM by hand over the same votes."""
    import math

    share, right = 0.8, [0.8] * len(names)

    def good(v):
        z = math.log(share / (1 - share)) + sum(x * math.log(r / (1 - r)) for x, r in zip(v, right, strict=True))
        return 1 / (1 + math.exp(-z))

    for _ in range(20):
        p = [good(v) for v in rows]
        new = []
        for i in range(len(names)):
            hit = sum(q if v[i] == 1 else 1 - q if v[i] == -1 else 0 for v, q in zip(rows, p, strict=True))
            new.append(min(0.98, max(0.6, (hit + 2) / (sum(abs(v[i]) for v in rows) + 4))))
        s = (sum(p) + 2) / (len(rows) + 4)
        moved = max(abs(a - b) for a, b in zip([s, *new], [share, *right], strict=True))
        share, right = s, new
        if moved < 1e-4:
            break
    return [share, *right]


def test_accuracies_and_verdicts_by_hand(spark):
    from lintlake.llm import quality_votes

    rnd = random.Random(8)
    rows = [tuple(rnd.choice([-1, 0, 0, 1, 1]) for _ in range(8)) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{v} int" for v in quality_votes.VOTES)).repartition(6)
    got = quality_votes.fit(df, quality_votes.VOTES)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, posterior_by_hand(rows, quality_votes.VOTES), strict=True))
