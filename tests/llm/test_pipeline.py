"""Decontamination against plain containment, the pipeline against a plain version of its stages, and SQL."""

import random

import duckdb

import corpus_pipeline
from docloom.llm import queries
from docloom.llm.decontaminate import BLOCK, THRESHOLD, _open_blocks, build_index, decontaminate, split_item, uncontaminated, wand

from .helpers import AWKWARD, docs, empty, plain


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long, contaminated boolean")


def test_decontamination_finds_planted_items(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n))
    bench = [(i, say(rng.randrange(12, 60)) + ". " + say(rng.randrange(1, 9)) + "?") for i in range(60)]
    pairs, want = [], {}
    for d in range(80):
        text = say(rng.randrange(0, 400))
        if d % 4 == 0:
            item, t = rng.choice(bench)
            text, want[d] = f"{text}\n{t.upper()} {say(rng.randrange(100))}", [item]
        pairs.append((d, text))
    rows = items(spark, [(i, t, 1, True) for i, t in bench])
    got = {r.doc_id: list(r.item_ids) for r in decontaminate(spark, plain(spark, pairs), rows).collect()}
    assert got == {d: want.get(d, []) for d, _ in pairs}


def test_long_items_are_found_at_every_place(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n))
    item = lambda n: say(n - 12) + ". " + say(12) + "?"
    bench = [(n, item(n)) for n in (30, 64, 65, 100, 128, 129, 200, 500, 513)]
    pairs, want = [], {}
    for n, text in bench:
        for lead in range(0, 512 if n > 256 else 256, 3 if n > 256 else 1):
            pairs.append((len(pairs), f"{say(lead)} {text} {say(rng.randrange(600))}"))
            want[len(pairs) - 1] = [n]
    pairs.append((len(pairs), say(3000)))
    rows = items(spark, [(i, t, 1, True) for i, t in bench])
    got = {r.doc_id: list(r.item_ids) for r in decontaminate(spark, plain(spark, pairs), rows).collect()}
    assert got == {d: want.get(d, []) for d, _ in pairs}


def test_wand_retrieves_all_above_threshold():
    rng = random.Random(2)
    bench = [(i, " ".join(f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 15)))) for i in range(50)]
    index = build_index(bench)
    import numpy as np

    for _ in range(50):
        query = np.unique([rng.randrange(len(index.terms)) for _ in range(20)])
        exact = {}
        for t in query:
            for k in range(index.bounds[t], index.bounds[t + 1]):
                exact[int(index.items[k])] = exact.get(int(index.items[k]), 0.0) + float(index.impacts[k])
        for threshold in (0.1, 0.4):
            found = dict(p for b in range(-(-50 // BLOCK)) for p in wand(index, query, b, threshold))
            assert set(found) == {i for i, s in exact.items() if s >= threshold}


def test_no_block_with_an_item_above_the_threshold_is_left_out():
    import numpy as np

    rng = random.Random(5)
    bench = [(i, " ".join(f"t{min(rng.randrange(80), rng.randrange(80))}" for _ in range(rng.randrange(1, 12)))) for i in range(90)]
    index = build_index(bench)
    pairs, want = [], set()
    for p in range(60):
        query = np.unique([rng.randrange(len(index.terms)) for _ in range(rng.randrange(1, 30))])
        score = np.zeros(90)
        for t in query:
            score[index.items[index.bounds[t] : index.bounds[t + 1]]] += index.impacts[index.bounds[t] : index.bounds[t + 1]]
        want |= {(p, int(k) // BLOCK) for k in np.flatnonzero(score >= THRESHOLD)}
        pairs += [(p, int(t)) for t in query]
    passage, known = (np.array(c) for c in zip(*pairs))
    opened = set(_open_blocks(index, passage, known, 0, -(-90 // BLOCK)))
    assert want <= opened and len(opened) < 60 * 23


def plain_matches(bench, texts):
    """Items by the operator's rule, with dictionaries: BM25 share, then question and answer shares, passage by passage."""
    import math
    import re as regex

    words = lambda t: regex.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    read = {i: words(t) for i, t in bench}
    n, mean = len(read), sum(map(len, read.values())) / len(read)
    df = {w: sum(w in own for own in read.values()) for own in read.values() for w in own}
    idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    impact = {i: {w: idf[w] * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in own} for i, own in read.items()}
    grams = lambda w, size: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}

    def share(part, held):
        size = min(3, len(part))
        own = grams(part, size)
        return len(own & grams(held, size)) / len(own) if size and own else 1.0

    out = []
    for text in texts:
        own, found = words(text), set()
        for i, t in bench:
            step = 64
            while len(read[i]) > step:
                step *= 2
            for at in range(0, max(1, len(own)), step):
                held = own[at : at + 2 * step]
                score = sum(v for w, v in impact[i].items() if w in set(held)) / sum(impact[i].values())
                if score >= 0.6 and all(share(words(p), held) >= 0.6 for p in split_item(t)):
                    found.add(i)
        out.append(sorted(found))
    return out


def test_decontamination_equals_plain_loops(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(f"{rng.choice('abcdé')}{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n))
    bench = [(i, say(rng.choice([5, 8, 20, 50, 90, 150, 300])) + ". " + say(rng.randrange(1, 9)) + "?") for i in range(30)]
    texts = []
    for _ in range(60):
        parts = [say(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            kept = [w if rng.random() > rng.choice([0, 0.1, 0.3]) else "zz" for w in rng.choice(bench)[1].split(" ")]
            parts += [" ".join(kept), say(rng.randrange(0, 100))]
        texts.append("\n".join(parts))
    want = plain_matches(bench, texts)
    assert sum(map(bool, want)) > 10
    rows = items(spark, [(i, t, 1, True) for i, t in bench])
    table = plain(spark, list(enumerate(texts)))
    for size in (1 << 20, 3000):
        got = {r.doc_id: list(r.item_ids) for r in decontaminate(spark, table, rows, size).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id for r in uncontaminated(spark, table.withColumn("found", table.text), rows).collect()} == {i for i, w in enumerate(want) if not w}


def test_decontamination_awkward(spark):
    rows = items(spark, [(1, None, 1, True), (None, "a b c", 1, True), (2, "", 1, True), (3, "short", 1, True), (4, "short", 1, True)])
    got = {r.doc_id: list(r.item_ids) for r in decontaminate(spark, docs(spark), rows).collect()}
    assert got[5] == [3, 4] and got[2] == [] and got[6] == []
    assert decontaminate(spark, docs(spark), items(spark, [])).where("contaminated").count() == 0
    assert decontaminate(spark, docs(spark), items(spark, [])).count() == len(AWKWARD)
    assert decontaminate(spark, empty(spark), rows).collect() == []


def test_pipeline_stages_take_effect(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    now, columns = table, table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, data)
        assert after.columns == columns
        before_ids, after_ids = {r.doc_id for r in now.collect()}, {r.doc_id for r in after.collect()}
        assert after_ids <= before_ids
        assert name == "toxicity" or (name == "pii") == (after_ids == before_ids)
        now = after
    assert not now.where(r"text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, now, data)
    assert tokens.count() == now.count() and tokens.where("n_tokens <> size(token_ids)").count() == 0


def small_corpus(folder, spark):
    """Tables with toxic, near-equal, contaminated and personal texts; returns the documents."""
    rng = random.Random(21)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))
    bench = [(i, say(rng.choice([14, 40, 90])) + ". " + say(9) + "?") for i in range(12)]
    rows = []
    for i in range(260):
        text = say(rng.randrange(30, 200))
        if i % 5 == 0:
            text = f"{say(20)} idiot {say(20)} {rng.choice(['idiot', 'moron'])} {say(4)}"
        elif i % 7 == 0 and rows:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 11 == 0:
            text = f"{text}\n{rng.choice(bench)[1]} {say(30)}"
        elif i % 3 == 0:
            text = f"{text} write zq.x{i}@mail.example and 10.0.{i % 200}.7 {say(10)}"
        rows.append((i, text, "en", "s", len(text)))
    rows += [(300, None, "en", "s", None), (301, "", "en", "s", 0), (None, say(40) + " idiot idiot moron", "en", "s", 1), (None, bench[0][1], "en", "s", 2), (None, say(30), "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Every stage by plain loops: scores, sets, passages, regular expressions, and the tiktoken library."""
    import base64
    import hashlib
    import math
    import re as regex

    import tiktoken

    from docloom.llm import byte_bpe, toxicity

    from .test_near_dedup import brute
    from .test_text_operators import KINDS

    rows, bench = small_corpus(str(tmp_path), spark)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    lexicon = toxicity.learn(spark, read("documents"), read("labels"))
    assert any("idio" in e for e in lexicon.weights)

    def toxic(text):
        folded, best = toxicity.fold(text), {}
        for entry, weight in lexicon.weights.items():
            for at in range(len(folded)):
                if folded.startswith(entry, at):
                    best[at] = max(best.get(at, 0.0), weight)
        total, (c, a, b) = sum(best.values()), lexicon.bias
        return c + a * math.log1p(total) + b * total / math.sqrt(1 + folded.count(" ")) >= 0

    assert not lexicon.exceptions
    now = [(i, t) for i, t, *_ in rows if not toxic(t)]
    assert sum(i is not None and i < 260 and i % 5 == 0 for i, _ in now) == 0 and len(now) > 150
    groups = brute([(i, t) for i, t in now if i is not None])
    after = [(i, t) for i, t in now if i is None or groups[i][1] == i]
    assert len(after) < len(now)
    now, held = after, plain_matches(bench, [t or "" for _, t in after])
    after = [row for row, found in zip(now, held) if not found]
    assert len(after) < len(now)

    def redacted(text):
        spans = sorted((m.start(), m.end(), k) for k, p, ok in KINDS for m in regex.finditer(p, text or "") if ok(m.group()))
        for start, end, kind in reversed(spans):
            text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
        return text

    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(byte_bpe.vocabulary_path(), "rb"))}
    library = tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in after:
        text = redacted(text) or ""
        ids = library.encode_ordinary(text)
        want.append((i if i is not None else -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_operators_on_a_very_long_text(spark):
    """Three megabytes in one row, and again with a small change, beside short rows."""
    from docloom.llm import langid, media, near_dedup, packing, pii, toxicity

    rng = random.Random(13)
    words = [f"{rng.choice(['wort', 'idiot', 'été', 'the'])}{rng.randrange(5000)}" for _ in range(400_000)]
    long = " ".join(words)
    words[1000] = "changed"
    item = "a rare question that stands nowhere else in here. it has one answer only?"
    table = plain(spark, [(1, long), (2, " ".join(words) + " " + item), (3, "short text of a few words"), (4, None)])
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark, table).collect()}
    assert got[2].component_id == 1 and got[1].n_shingles > 300_000 and got[3].kept
    assert {r.doc_id for r in decontaminate(spark, table, items(spark, [(7, item, 1, True)])).collect() if r.contaminated} == {2}
    assert toxicity.toxicity(spark, table, spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")).count() == 4
    assert {r.doc_id: r.n_bytes for r in media.media_columns(spark, table).select("doc_id", "n_bytes").collect()}[1] == len(long.encode())
    model = langid.train([(b"the quick brown fox", "en"), ("été déjà vu".encode(), "fr")], steps=2)
    assert {r.doc_id: r.lang_pred for r in langid.identify(spark, table, model).collect()}[4] == "und"
    assert packing.pack(spark, table, with_arrays=False).selectExpr("sum(n_tokens)").first()[0] > 1_000_000
    assert pii.find_pii(table).count() == 4


def test_pipeline_awkward(spark, data):
    table = docs(spark).drop("id", "a", "words", "score", "runs", "bucket", "place", "comp", "pii")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, data).count() >= 1
        assert stage(spark, table.limit(0), data).count() == 0


def test_sql_of_queries(spark, data):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, data)
        want = con.execute(sql)
        order = [d[0] for d in want.description]
        assert sorted(order) == sorted(got.columns)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.select(*order).collect()), key=key) == sorted(want.fetchall(), key=key)
