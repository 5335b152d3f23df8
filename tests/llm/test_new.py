"""Vector codes, spelling variants and toxicity against brute force, on edges, and on held-out rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import quality, queries, spelling, toxicity, vector_codes

R = random.Random(5)
NAN, INF = float("nan"), float("inf")


def lloyd(vectors, parts, entries, rounds):
    """Codes, errors and codebooks of (id, vector) rows, part by part, without running sums."""
    rows = sorted(vectors)
    width = len(rows[0][1])
    each = -(-width // parts)
    x = [[[int(np.floor(256 * c)) for c in v][p * each : (p + 1) * each] + [0] * max(0, min(each, (p + 1) * each - width)) for p in range(parts)] for _, v in rows]
    books = [[list(own[p]) for own in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    nearest = lambda p, own: min(range(len(books[p])), key=lambda e: (far(own[p], books[p][e]), e))
    for _ in range(rounds):
        codes = [[nearest(p, own) for p in range(parts)] for own in x]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(x, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [[nearest(p, own) for p in range(parts)] for own in x]
    errors = [sum(far(own[p], books[p][c[p]]) for p in range(parts)) for own, c in zip(x, codes, strict=True)]
    return {i: ("".join(f"{c:02x}" for c in cs), e) for (i, _), cs, e in zip(rows, codes, errors, strict=True)}, books


@pytest.mark.parametrize("width, n, entries, rounds", [(64, 300, 64, 2), (40, 90, 16, 3), (16, 10, 64, 2), (5, 40, 7, 1)])
def test_vector_codes_by_brute_force(spark, width, n, entries, rounds):
    rows = [(R.randrange(10_000) * 1000 + k, [R.gauss(0, 0.3) for _ in range(width)], k % 3) for k in range(n)]
    rows += [(5_000_000_000 + k, rows[0][1], 0) for k in range(20)]  # a group of copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    codes, book = vector_codes.compress(df, parts=16, entries=entries, rounds=rounds)
    want, books = lloyd([(i, v) for i, v, _ in rows], 16, entries, rounds)
    assert {r.vec_id: (r.code, r.error) for r in codes.collect()} == want and book.tolist() == books


def test_vector_codes_edges(spark):
    """Null, short, empty and non-finite vectors go; null labels are one label; repeats, huge components, odd names."""
    v = [0.5] * 32
    rows = [(1, v, 7, "x"), (1, v, 7, "y"), (2, [1e300] + v[1:], None, "x"), (None, [-1e30] * 32, None, None), (3, None, 1, "x"), (4, [*v[1:], None], 1, "x"), (5, [*v[1:], NAN], 1, "x"), (6, [*v[1:], -INF], 1, "x"), (7, [], 1, "x"), (8, v[:16], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, `a.b` string").repartition(3)
    codes, book = vector_codes.compress(df)
    out = vector_codes.label_errors(codes).collect()
    assert sorted(str(r.vec_id) for r in out) == ["1", "1", "2", "None"] and book.shape == (16, 4, 2)
    sums = defaultdict(int)
    for r in out:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in out) and abs(book).max() <= vector_codes.LARGEST
    none, book = vector_codes.compress(df.where("false"))
    assert none.count() == 0 and none.columns == codes.columns and book.size == 0
    renamed = df.withColumnRenamed("embedding", "v.c").withColumnRenamed("vec_id", "i.d")
    assert vector_codes.compress(renamed, id_col="i.d", vector_col="v.c")[0].count() == 4
    with pytest.raises(ValueError):
        vector_codes.compress(df, entries=257)


def test_vector_rounds_move_only_changes(spark):
    """Sums kept by plus and minus equal sums over all parts, and a round's changed rows are those that moved."""
    x = np.array([[R.randrange(-90, 90) for _ in range(32)] for _ in range(60)], np.int32)
    book = np.array([[[R.randrange(-90, 90), R.randrange(-90, 90)] for _ in range(5)] for _ in range(16)], np.int64)
    one, _ = vector_codes._nearest(x.reshape(60, 16, 2).astype(np.int64), book)
    two, _ = vector_codes._nearest(x.reshape(60, 16, 2).astype(np.int64), book + 40)
    rows = [(i, "l", v.tobytes(), b.tobytes(), a.tobytes()) for i, (v, a, b) in enumerate(zip(x, one, two, strict=True))]
    state = spark.createDataFrame(rows, "vec_id long, label string, x binary, code binary, before binary").repartition(4)
    first = vector_codes._added(state.select("x", F.col("before").alias("code")), 16, 5, 2)
    more = vector_codes._added(state, 16, 5, 2)
    whole = vector_codes._added(state.select("x", "code"), 16, 5, 2)
    assert (first[0] + more[0] == whole[0]).all() and (first[1] + more[1] == whole[1]).all() and abs(more[1]).sum() < abs(whole[1]).sum() * 2


def brute_variants(counts, times=10):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w in counts:
        close = sorted((-n, v) for v, n in counts.items() if near(w, v))
        form = close[0][1] if close and -close[0][0] >= times * counts[w] else None
        out[w] = (form, counts[w], len(close), counts[form] if form else None)
    for w in counts:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


@pytest.mark.parametrize("most", [1024, 30, 3])
def test_variants_by_brute_force(spark, most):
    """Whatever the size of a shard from which it is cut, every pair counts once: repeated letters, ends, one long word."""
    base = ["".join(R.choice("abcé") for _ in range(R.randrange(7, 12))) for _ in range(90)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "a" * 400, "a" * 401, "abababab", "babababa", "abababa"]
    counts = {}
    for w in base:
        counts[w] = R.choice([2, 3, 40, 900, 12_000])
        for _ in range(4):
            k, c = R.randrange(len(w)), R.choice("abcé")
            v = R.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w + c])
            if len(v) >= 7:
                counts.setdefault(v, R.choice([2, 5, 30, 500]))
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, most=most).collect()}
    assert got == brute_variants(counts) and any(x[1] != (x[0] or w) for w, x in got.items())


def test_merged_lists_by_brute_force():
    for _ in range(500):
        lists = [sorted(R.sample(range(12), R.randrange(8))) for _ in range(R.randrange(1, 6))]
        for bound in range(1, len(lists) + 1):
            n = Counter(x for own in lists for x in own)
            assert spelling.merged(lists, bound) == sorted(x for x in n if n[x] >= bound)


def test_words_and_their_edges(spark):
    texts = ["Straße Übermut übermut ABCDEFGH abcdefgh ÀÉÈÇÀÉÈ", "word" * 3 + "×÷" + " abcdefgh", None, "", "short words only", "x" * 300_000 + " " + "x" * 300_000]
    rows = [(k, t, "w", 1) for k, t in enumerate(texts * 3)] + [(None, texts[0], "w", 1), (0, texts[0], "w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    want = Counter()
    for i, t, *_ in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            want[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.words(df).collect()} == want
    out = spelling.spelling_variants(df)
    assert out.count() == len(want) and spelling.spelling_variants(df.where("false")).columns == out.columns
    assert spelling.spelling_variants(df.where("false")).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("op11_vector_codes", "op12_spelling"):
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        cursor = con.execute(queries.oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(str(tuple(r)) for r in df.select(columns).collect()) == sorted(map(str, cursor.fetchall()))


def test_toxicity_held_out(spark):
    """Of the labels that aren't learned: precision, recall and rank."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.score, r.predicted) for r in queries.op13_toxicity(spark, sf).where("held_out").collect() if r.doc_id in labels]
    toxic, clean = [x for x in rows if x[0]], [x for x in rows if not x[0]]
    caught = sum(p for *_, p in toxic)
    assert caught / sum(p for *_, p in rows) >= 0.9 and caught / len(toxic) >= 0.8
    assert np.mean([[a > b for _, b, _ in clean] for _, a, _ in toxic]) >= 0.93


def _model(known=40):
    h = np.sort(np.array(R.sample(range(1 << 32), known), np.uint32))
    e, f, b, o, c = toxicity._start(np.linspace(-2, 3, known))
    return toxicity.Model(h, e, f, b, o, float(c[0]), ["en", "fr"], np.array([[0.0, 0.0], *[[R.random(), R.random()] for _ in range(known)]]), np.array([0.2, 0.6, 0.4]))


def test_pooling_by_brute_force(monkeypatch):
    """Every window of a whole text, whatever the pieces it is cut in."""
    m = _model()
    for n in (0, 1, 2, 3, 5, 17, 64):
        ids = np.array([R.randrange(41) for _ in range(n)], np.int32)
        padded = np.concatenate([m.embedding[ids], np.zeros((2, toxicity.SIZE), np.float32)])
        want = []
        for w, width in enumerate(toxicity.WIDTHS):
            first = sum(toxicity.WIDTHS[:w])
            blocks = [m.filters[:, (first + j) * toxicity.FILTERS : (first + j + 1) * toxicity.FILTERS] for j in range(width)]
            want += [max((float(sum(padded[i + j] @ blocks[j][:, k] for j in range(width))) for i in range(n)), default=0.0) for k in range(toxicity.FILTERS)]
        for piece in (1 << 15, 1, 2, 5):
            monkeypatch.setattr(toxicity, "PIECE", piece)
            assert np.allclose(toxicity.pooled(m, ids), want, atol=1e-5)


def test_threshold_has_the_best_f1():
    for _ in range(200):
        n = R.randrange(2, 15)
        p, t = np.array([R.randrange(6) / 5 for _ in range(n)]), np.array([R.randrange(2) for _ in range(n)])
        t[0] = 1
        f1 = lambda cut: 2 * t[p >= cut].sum() / ((p >= cut).sum() + t.sum())
        assert np.isclose(f1(toxicity._threshold(p, t)), max(f1(c) for c in p))


def test_languages_move_the_threshold():
    """A text at its language's threshold scores THRESHOLD; what is above it counts as toxic."""
    m = _model()
    for _ in range(50):
        h = np.array([R.choice(m.known) for _ in range(12)], np.uint32)
        ids = toxicity._ids(m.known, h)
        p = 1 / (1 + np.exp(-toxicity._log_odds(m, ids)))
        assert (toxicity.score(m, h) >= toxicity.THRESHOLD) == (p >= m.thresholds[toxicity._language(m, ids)])
    assert toxicity._language(m, np.zeros(3, np.int32)) == 2


def test_fitting_lowers_the_loss():
    m = _model()
    rows = [(k % 2, np.array([R.randrange(1, 20) + 20 * (k % 2) for _ in range(R.randrange(0, 9))], np.int32)) for k in range(60)]
    start = [m.embedding, m.filters, m.bias, m.out, np.array([m.base], np.float32)]

    def loss(layers):
        own = toxicity.Model(m.known, *layers[:4], float(layers[4][0]), [], m.spoken, m.thresholds)
        z = np.array([toxicity._log_odds(own, ids) for _, ids in rows])
        return float(np.mean(np.log1p(np.exp(np.where([t for t, _ in rows], -z, z)))))

    after = toxicity.fit_shard(rows, start, 1)
    assert loss(after) < 0.7 * loss(start) and not after[0][0].any()


def test_toxicity_edges(spark):
    """Null and empty texts, repeats, unknown labels, odd names, no labels; the model depends on the rows alone."""
    say = lambda k: " ".join(R.choice("the of and to in is was that it for".split()) for _ in range(9)) + (" vile" if k % 3 == 0 else "")
    rows = [(k, say(k), "en", "z") for k in range(120)] + [(200, None, None, None), (201, "", "en", "z"), (None, "the vile", "en", "z"), (202, " \n", "en", None), (203, "vile " * 50_000, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)] + [(3, None), (5, 9), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df.repartition(3), labels)
    again = toxicity.fit(df.unionByName(df.where("doc_id < 30")).repartition(5), labels.repartition(2))
    assert all(np.array_equal(getattr(model, c), getattr(again, c)) for c in ("known", "embedding", "filters", "bias", "out", "thresholds"))
    out = toxicity.score_documents(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD) for r in out)
    found = {r.doc_id: r.predicted for r in out}
    assert sum(found[k] == (k % 3 == 0) for k in range(120)) >= 114 and found[203] == 1 and found[200] == found[201] == found[202] == 0
    assert toxicity.score_documents(df.where("false"), model).count() == 0
    none = toxicity.fit(df, labels.where("false"))
    assert len({r.score for r in toxicity.score_documents(df, none).collect()}) == 1
    odd = df.withColumnRenamed("text", "a.b").withColumnRenamed("doc_id", "i.d")
    assert toxicity.score_documents(odd, model, "i.d", "a.b").count() == len(rows)
    assert toxicity.fit(df, labels, lang_col=None).langs == []


def test_toxicity_learns_from_every_label(spark):
    """A word that tells and stands only in documents beyond the first 20,000 by the hash of their id."""
    docs = spark.range(21_000).selectExpr("id as doc_id", "row_number() over (order by xxhash64(id), id) > 20000 as late")
    docs = docs.selectExpr("doc_id", "concat('the of and n', doc_id, if(late, ' vile', ' mild')) as text", "'en' as lang", "cast(late as int) as toxic").localCheckpoint()
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    out = toxicity.score_documents(spark.createDataFrame([(1, "of the vile"), (2, "of the mild")], "doc_id long, text string"), model)
    assert {r.doc_id: r.predicted for r in out.collect()} == {1: 1, 2: 0}


def test_toxicity_by_many_shards(spark, monkeypatch):
    """Many shards, some words in one of them only: the model depends on the rows alone and still tells."""
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 400)
    rows = [(k, " ".join(R.choice("the of and to in is was that it for".split()) for _ in range(9)) + (" vile" if k % 3 == 0 else ""), "en") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = df.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    model, again = toxicity.fit(df.repartition(3), labels), toxicity.fit(df.repartition(7), labels)
    assert all(np.array_equal(getattr(model, c), getattr(again, c)) for c in ("known", "embedding", "filters", "bias", "out", "thresholds"))
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in toxicity.score_documents(df, model).collect()) >= 590


def test_quality_held_out(spark):
    """Ratings that aren't learned from: how often the higher grade has the higher expected grade, and poor and toxic
    texts that are kept."""
    sf = "/root/testdata/sf0.1"
    docs, rated = spark.read.parquet(f"{sf}/documents.parquet"), quality.graded(spark.read.parquet(f"{sf}/labels.parquet"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.fit(docs, rated.where(~out))
    rows = quality.grade(docs.join(rated.where(out), "doc_id", "left_semi"), model).join(rated, "doc_id").collect()
    pairs = [(a.expected_grade > b.expected_grade) + 0.5 * (a.expected_grade == b.expected_grade) for a in rows for b in rows if a.grade > b.grade]
    kept = [r for r in rows if r.keep]
    print("rank", np.mean(pairs), "kept", len(kept), "of", sum(r.grade == 2 for r in rows), "good", sum(r.grade == 2 for r in kept))
    assert np.mean(pairs) >= 0.8 and sum(r.grade == 2 for r in kept) / len(kept) >= 0.85
