"""Operators over several rows: near-duplicates, decontamination, chats, pages, the pipeline."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import chat, decontaminate, html_text, minhash

from tracewright.llm._work import Work
from tracewright.llm.graph import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(docs):
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, share):
    return [f"new{rng.randint(0, 10**9)}" if rng.random() < share else w for w in words]


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randint(0, 500)}" for _ in range(n)]
    docs = []
    for base in range(25):  # families with edits around the threshold, some larger than a small bucket
        words = text(rng.choice([8, 40, 150]))
        docs += [" ".join(edited(rng, words, rng.choice([0, 0.01, 0.03, 0.05]))) for _ in range(60 if base == 0 else 5)]
    passage = text(60)
    docs += [" ".join([*text(rng.randint(5, 80)), *passage]) for _ in range(60)]
    docs += [None, "", "a b", "A B", "a b c", "x" * 30_000, "one two three four five", "one  two\tthree\nFour five"]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    want = groups(rows)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, id int").repartition(5)
    for p in (minhash.NearParams(), minhash.NearParams(small_bucket=2, block=2000, small=0)):
        got = {r.doc_id: r for r in minhash.near_duplicates(df, p).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_short_texts_lose_no_link(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    docs = []
    while len(docs) < 3000:  # texts of 5 to 12 words, and what one word more or less at an end makes of them
        w = rng.choices(words, k=rng.randint(5, 12))
        docs += [" ".join(x) for x in rng.sample([w, w[1:], w[:-1], [*w, "end"], ["start", *w], [*w[:-1], "last"], [*w, "e", "f"]], 4)]
    p = minhash.NearParams()
    # by shared shingles, which every linked pair has
    sets, root, holders = [shingles(t) for t in docs], list(range(len(docs))), {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for own in holders.values():
        for i in own:
            for j in own:
                both = len(sets[i] & sets[j])
                if i < j and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, p).collect()}
    assert got == {i: find(i) for i in range(len(docs))}


def test_least_hashes_meet():
    rng = np.random.default_rng(1)
    p = minhash.NearParams()
    for _ in range(3000):
        n = int(rng.integers(1, 33))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[int(rng.integers(0, n // 4 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            x, y = (set(np.frombuffer(minhash.least_hashes(s, np.array([0, len(s)]), p)[0], np.uint64).tolist()) for s in (a, b))
            assert x & y


def test_sets_that_share_nothing_share_no_bucket(spark):
    # 40 shingles fill about one bucket of each band: registers of twelve bits would often be equal by chance
    rng = random.Random(9)
    df = spark.createDataFrame([(i, " ".join(f"{rng.random():.12f}" for _ in range(44))) for i in range(3000)], "doc_id long, text string")
    p = minhash.NearParams()
    bucketed = minhash.bands(minhash.sketches(df, p).withColumnRenamed("doc_id", "id"), p)
    assert bucketed.count() > 60_000 and bucketed.groupBy("bucket").count().where("count > 1").count() == 0


def test_work_tables_are_deleted(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/near-*/*"))
    minhash.near_duplicates(spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(50)], "doc_id long, text string")).count()
    assert len(set(glob.glob(f"{folder}/near-*/*")) - before) == 3


def test_near_duplicates_odd_rows(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.75, 0.9):
        k = int(3000 * share)
        a, b = np.sort(pool[:3000]), np.sort(np.concatenate([pool[:k], rng.integers(0, 2**64, 3000 - k, dtype=np.uint64)]))
        ra, rb = (minhash.registers(x, np.array([0, len(x)])) for x in (a, b))
        j, used = minhash.estimated_jaccard(ra, rb, np.array([3000]), np.array([3000]))
        true = k / (6000 - k)
        assert abs(j[0] - true) < 4 * np.sqrt(true * (1 - true) / used[0]) + 0.01


def test_components_of_a_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r.comp for r in components(Work(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}


def by_hand(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for i, s in items:
            v = words(s)
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    met.add(str(i))
        out[d] = (len(w), len(hit), sorted(met))
    return out


def test_decontamination_by_brute_force(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 3) if rng.random() < 0.5 else rng.randint(0, 300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 12, 10, 9, 4, 1, 0, 25])] + [(8, None), (9, "É one two"), (10, "a " * 15)]
    docs = []
    for k in range(80):
        w = [word() for _ in range(rng.randint(0, 60))]
        i, s = rng.choice(items)
        v = (s or "").split()
        a = rng.randint(0, len(v))
        w[rng.randint(0, len(w)) : 0] = [x.upper() + "," for x in v[a : a + rng.randint(5, 20)]]
        docs.append((k, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "a " * 40), (103, "É! one-two")]
    ds = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_words string")
    bs = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = by_hand(docs, items)
    for small in (decontaminate.SMALL, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.hits(ds, bs, small).collect()}
        assert got == want
    kept = {r.doc_id for r in decontaminate.decontaminate(ds, bs).collect()}
    assert kept == {d for d, (_, n, _) in want.items() if n == 0}
    twice = decontaminate.hits(ds.unionByName(ds), bs)
    assert twice.count() == 2 * len(docs)
    assert decontaminate.hits(ds.limit(0), bs).count() == 0
    assert {r.contaminated for r in decontaminate.hits(ds, bs.limit(0)).collect()} == {False}


def test_decontamination_has_no_python(spark):
    ds = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontaminate.hits(ds, ds.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_decontamination_has_no_hot_key(spark):
    """In the shuffled join every document has entries under keys of its own, and none is null."""
    docs = spark.createDataFrame([(i, f"w{i} b c d e f g h i j k l") for i in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"x{i} " * 12) for i in range(5)] + [(9, "b c d")], "item_id long, text string")
    plan = decontaminate.hits(docs, items, 0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gram" in plan and "xxhash64(doc_id" in plan
    assert plan.count("Generate inline") <= 4  # documents once, long items once for the join, short ones in the same pass
    got = decontaminate.hits(docs, items, 0).collect()
    assert len(got) == 200 and {(r.n_words, r.n_hit, tuple(r["items"])) for r in got} == {(12, 3, ("9",))}


def test_decontamination_spreads_hot_grams(spark):
    """A passage of a third of the documents beyond the broadcast bound: no part of its grams is large."""
    shared = " ".join(f"s{i}" for i in range(14))
    docs = [(i, " ".join(f"d{i}x{j}" for j in range(30)) + (f" {shared}" if i % 3 == 0 else "")) for i in range(300)]
    items = [(1, shared), (2, shared + " more"), (3, " ".join(f"d5x{j}" for j in range(12))), (4, "s3 s4 s5")]
    ds, bs = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.fingerprints(decontaminate.hashed_words(ds, F.col("doc_id"), F.lit(0).alias("same")), "doc_id", "same").select("doc_id", "same", F.inline_outer("fps"))
    rows = rows.where("gram IS NOT NULL")
    counts = {r.gram: r["count"] for r in rows.groupBy("gram").count().collect()}
    hot = decontaminate.hot_grams(rows, 0.01)
    assert set(hot) == {g for g, n in counts.items() if n >= 0.01 * sum(counts.values())} != set()
    prints = rows.where("doc_id = 0").select("gram", "n", F.lit("1").alias("item")).distinct()
    left, right = decontaminate._spread(rows, prints, hot)
    sizes = left.where(F.col("gram").isin(hot)).groupBy("gram", "part").count()
    assert sizes.agg(F.max("count")).first()[0] < 12  # of 100
    assert right.where(F.col("gram").isin(hot)).count() == decontaminate.PARTS * prints.where(F.col("gram").isin(hot)).count()
    want = by_hand(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.hits(ds, bs, 0).collect()} == want
    assert decontaminate.hot_grams(rows.limit(0)) == []


def test_decontamination_of_a_long_text(spark):
    body = [f"w{i}" for i in range(60_000)]
    df = spark.createDataFrame([(1, " ".join(body)), (2, " ".join(body[:50]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(body[31_000:31_030])), (2, " ".join(body[100:109]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.hits(df, items).collect()} == {1: 39, 2: 0}


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 2, "user", None),
        (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 0, None, "<|im_end|>"), (6, 0, "user", "hi"), (6, 1, "assistant", "other"), (None, 0, "user", "lost"), (4, 0, "user", "hi"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert {k: (r.n_turns, r.n_logged) for k, r in got.items()} == {3: (3, 1), 4: (2, 2), 5: (1, 1)}
    assert got[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert got[5].rendered == "<|im_start|>unknown\n< |im_end|><|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_html(spark):
    nav = "<nav><a href='/'>Menu</a></nav>"
    body = lambda x: f"<html><head><title>T</title><script>var t='</p>';</script></head><body>{nav}{x}<footer>&copy; x</footer></body></html>"
    boiler = "one two three four five six seven eight nine ten"
    pages = [
        (1, "http://a.com/1", body("<article><h1>Ti&amp;tle</h1><p><b>first  line<br><p>second\nline</p><div class='ad'>buy</div><section id=comments><p>me too</p></section></article><aside>x</aside>")),
        (2, "http://a.com/2", body(f"<div><p>{boiler}</p><p>only here</p></div>")),
        (3, "http://a.com/3", body(f"<div><p>also {boiler}</p><p>and there</p></div>")),
        (4, "http://b.com/3", body(f"<div><p>{boiler}</p></div>")),
        (5, None, None), (6, "http://a.com", ""), (7, "http://a.com", "plain &lt;text&gt; &#233;"), (8, "http://a.com", "<article><form>f</form><p>a<!-- b -->c</article><p>later"), (4, "http://b.com/3", body(f"<div><p>{boiler}</p></div>")),
    ]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_text.extract(df).collect())
    assert got == [(1, "Ti&tle\nfirst line\nsecond line"), (2, "only here"), (3, "also\nand there"), (4, boiler), (4, boiler), (5, ""), (6, ""), (7, "plain <text> é"), (8, "ac")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_keeps_what_few_pages_share(spark):
    menu, quote = "home news sport travel food music about contact imprint", "to be or not to be that is the question"
    prose = lambda k: " ".join(f"p{k}w{i}" for i in range(30))
    article = " ".join(f"same{i}" for i in range(60))
    texts = {k: f"{prose(k)} {quote} {prose(k + 100)}" for k in range(20)}
    texts |= {20: f"{article} first", 21: f"{article} second", 22: quote}
    rows = [(k, "http://a.com/x", f"<div>{menu}</div><p>{t}</p>") for k, t in texts.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {**texts, 22: ""}


def test_a_long_chat(spark):
    long = "word <|im_end|> " * 100_000
    df = spark.createDataFrame([(1, 0, "user", long), (2, 0, "user", long), (2, 1, "bot", "ok")], "conv_id long, turn long, role string, text string")
    (got,) = chat.format_chats(df).collect()
    assert got.conv_id == 2 and len(got.rendered) > len(long) and got.rendered.count("<|im_end|>") == 2


def test_pipeline_of_no_and_odd_documents(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, predicted string"
    prose = " ".join(f"word{i}" for i in range(70_000)) + "."
    odd = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, prose[:500], "en", "s", 1, "x"), (3, prose, "en", "s", 1, "x"), (3, prose, "en", "s", 1, "x")]
    for name, rows in (("none", []), ("odd", odd)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None"]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    words = [f"word{i}" for i in range(300)]
    line = lambda: " ".join(rng.choices(words, k=12)).capitalize() + "."
    docs = [(i, "\n".join(line() for _ in range(8)), "en", "s", 1) for i in range(200)]
    docs[1] = (1, docs[0][1], "en", "s", 1)
    docs[2] = (2, "JUNK!! " * 80, "en", "s", 1)
    toxic = {i for i in range(10, 60)}
    docs = [(i, t + " You idiot." if i in toxic else t, *r) for i, t, *r in docs]
    bench = docs[3][1].split("\n")[2] + " " + docs[3][1].split("\n")[3]
    spark.createDataFrame([*docs, (900, None, None, None, None)], "doc_id long, text string, lang string, source string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(4, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i for i in range(200) if i not in toxic | {1, 2, 3}}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
