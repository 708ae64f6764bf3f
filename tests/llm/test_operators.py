"""Corpus operators against brute force, on texts with every odd case: nulls, empties, repeats, ties, clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldt.llm import decontaminate, line_dedup, lm_score, mixing, ngram_join, pii, quality_rules, token_store, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in "th er on an re st ou in ent ble".split() for b in ("", "ing", "ed", "ly", "s", "or")]


def prose(rng, n):
    out = []
    for k in range(n):
        out.append(rng.choice(VOCABULARY))
        if k % 11 == 10:
            out[-1] += "." + ("\n" if rng.random() < 0.5 else "")
    return " ".join(out).replace("\n ", "\n")


def corpus():
    """(doc_id, text, source) with copies, near copies, repeats, nulls and empties."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 12, 80, 200])) for _ in range(40)]
    base = prose(rng, 150)
    near = []
    for k in range(6):
        words = base.split(" ")
        words[20 * k] = f"changed{k}"
        near.append(" ".join(words))
    texts += [base, base, *near, None, None, "", " \t\n", "one two three", "one two three", "a b c d e a b c d e", "x" * 3000, "é ß <|endoftext|> Σ's don't 12,5. A.B, Ünïcode word"]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return [*rows, rows[40], (None, "a null id " * 4, "s1"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, 1, "row", 2.0) for i, t, s in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, rate double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality_measures_and_verdicts(docs, empty):
    def expected(t):
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)

    found = quality_rules.judge(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted((str(r[0]), *r[1:6]) for r in found) == sorted((str(i), *expected(t)) for i, t, _ in corpus())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in found)
    assert quality_rules.filter_good(docs).columns == docs.columns
    assert quality_rules.filter_good(docs).count() == sum(r.kept for r in found)
    assert quality_rules.judge(empty, ["doc_id"]).count() == 0 and quality_rules.filter_good(empty).count() == 0


def test_quality_em_learns_which_rules_are_right():
    rng = random.Random(1)
    counts = collections.Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = [(1 if good else -1) * (1 if rng.random() < p else -1) if rng.random() < 0.9 else 0 for p in (0.97, 0.9, 0.85, 0.6)]
        counts[tuple(votes)] += 1
    model = quality_rules.fit(sorted(counts.items()), list("abcd"))
    assert abs(model.prior - 0.8) < 0.05 and model.hit["a"][0] > model.hit["c"][0] > model.hit["d"][0]
    assert quality_rules.fit([], ["a"]).hit == {"a": quality_rules.START}


def shingles(t):
    w = WORD.findall(t or "")
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def similar(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def test_ngram_join_has_every_link(docs, empty):
    rows = [(i, shingles(t)) for i, t, _ in corpus()]
    links = [sum(similar(s, u) for k, (_, u) in enumerate(rows) if k != j) for j, (_, s) in enumerate(rows)]
    group = list(range(len(rows)))
    for _ in rows:
        for j, (_, s) in enumerate(rows):
            for k, (_, u) in enumerate(rows):
                if similar(s, u):
                    group[j] = group[k] = min(group[j], group[k])
    named = collections.defaultdict(list)
    for g, (i, _) in zip(group, rows, strict=True):
        named[g] += [i] if i is not None else []
    want = sorted((str(i), str(min(named[g]) if named[g] else None), n) for (i, _), g, n in zip(rows, group, links, strict=True))
    found = ngram_join.join(docs)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in found.collect()) == want
    kept = ngram_join.keep_one(docs)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == docs.columns and sum(not shingles(t) for t in texts) == sum(not s for _, s in rows)
    assert len(texts) == len(set(group)) and not any(similar(shingles(a), shingles(b)) for k, a in enumerate(texts) for b in texts[:k])
    assert ngram_join.join(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_ngram_join_over_small_blocks(spark):
    rng = random.Random(3)
    words = prose(rng, 120).split(" ")
    texts = []
    for k in range(40):
        w = list(words)
        w[rng.randrange(len(w))] = f"n{k}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from veldt.llm.common import Stage

    rows, classes = ngram_join.link(frame, Stage(spark, "t"), block=8)
    got = {r.doc_id: r.n_links for r in rows.join(classes, ["high", "low"]).collect()}
    sets = [shingles(t) for t in texts]
    assert got == {j: sum(similar(s, u) for k, u in enumerate(sets) if k != j) for j, s in enumerate(sets)}


def test_pruning_bounds():
    need = ngram_join.needed(0.8, 1e-6)
    assert need == sorted(need) and all(n < 0.8 * k * ngram_join.STEP for k, n in enumerate(need, 1))


def test_lm_scores(docs, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*WORD.findall((t or "").translate(low)), None]) for i, t, _ in corpus()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in tokens)
    found = lm_score.score(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)
    assert lm_score.score(empty).count() == 0


def test_lm_scores_are_those_of_brute_force(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 3_000)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fold = lambda i: 2 if i is None else zlib.crc32(str(i).encode()) % 5
    rows = [(i, fold(i), [*WORD.findall((t or "").translate(low)), ""]) for i, t, _ in corpus()]

    def counts(folds):
        one, two, n = collections.Counter(), collections.Counter(), 0
        for _, f, t in rows:
            if f in folds:
                one.update(t), two.update(zip([None, *t[:-1]], t, strict=True))
                n += 1
        one[None] = n
        return one, two

    def parts(c, t):
        one, two = c
        n, v = sum(x for w, x in one.items() if w is not None), len([w for w in one if w is not None])
        for a, b in zip([None, *t[:-1]], t, strict=True):
            yield one[a], two[a, b] / max(1, one[a]), (one[b] + 0.5) / (n + 0.5 * (v + 1))

    rest, seen = counts({2, 3, 4}), collections.defaultdict(list)
    for _, f, t in rows:
        if f == 0:
            for c, likely, base in parts(rest, t):
                if c:
                    seen[c.bit_length()].append(round(math.log(likely / base) * 1000) / 1000 if likely else -math.inf)
    weights = {}
    for b in range(40):
        w = 0.5 if b in seen else weights.get(b - 1, 0.0)
        for _ in range(200 if b in seen else 0):
            r = np.exp(seen[b])
            w = float((w * r / (w * r + 1 - w)).mean())
        weights[b] = min(w, 1 - 1e-6)
    every = counts({0, 2, 3, 4})
    want = sorted((str(i), round(sum(math.log10(weights[c.bit_length()] * (c > 0) * likely + (1 - weights[c.bit_length()] * (c > 0)) * base) for c, likely, base in parts(every, t)), 5)) for i, _, t in rows)
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in lm_score.score(docs).collect()) == want


def test_lm_weights_and_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (lm_score.unpack(lm_score.pack(keys)) == keys).all()
    up, none = int(math.log(10) * lm_score.ROUND) + lm_score.CLIP + 1, 0
    w = lm_score.learn_weights([(3, up, 90), (3, none, 10), (5, none, 50)])
    assert 0.8 < w[3] < 0.95 and w[5] < 0.01 and w[0] == 0  # by hand: 0.9 - 0.1 / 9
    assert w[2] == 0 and w[4] == w[3] and w[39] == w[5]


def test_line_runs(docs, empty, spark):
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.report(docs).collect()}
    assert len(got) and all(r.n_lines == len((t or "").split("\n")) for (i, _), r in got.items() for j, t, _ in corpus() if i == j is not None)
    passage = "\n".join(" ".join(f"w{k}{j}" for j in range(9)) + "." for k in range(7))  # 63 words
    other = lambda k: "\n".join(" ".join(f"o{k}{a}{b}" for b in range(12)) for a in range(4))
    texts = [other(1) + "\n" + passage, passage + "\n" + other(2), other(3) + "\n\n" + passage + "\n" + other(4), other(5), "short line\n" * 3, passage + "\n" + passage, None]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    clean = {r.doc_id: r.text for r in line_dedup.dedup(frame).collect()}
    assert clean == {0: texts[0], 1: other(2), 2: other(3) + "\n\n" + other(4), 3: texts[3], 4: texts[4], 5: "", 6: None}
    assert line_dedup.dedup(frame).columns == frame.columns and line_dedup.report(empty).count() == 0


def brute_runs(texts):
    """By text, the lines in runs of 50 words or more that an earlier place (text, then line) has."""
    lines = [(t or "").split("\n") for t in texts]
    size = lambda x: len(WORD.findall(x))
    out = []
    for d, own in enumerate(lines):
        gone = set()
        for e in range(d + 1):
            for shift in range(-len(own) + 1, len(lines[e]) if e < d else 0):
                run = []
                for i in range(len(own) + 1):
                    if i < len(own) and 0 <= i + shift < len(lines[e]) and own[i] == lines[e][i + shift]:
                        run.append(i)
                    else:
                        gone |= set(run) if sum(size(own[k]) for k in run) >= 50 else set()
                        run = []
        out.append(",".join(map(str, sorted(gone))))
    return out


def test_line_runs_whose_parts_occur_first_elsewhere(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(25)) for c in "abc")
    texts = [one, two, three, *["\n".join([one, two, three])] * 2]
    rng = random.Random(8)
    pool = [*(" ".join(f"p{k}w{j}" for j in range(n)) for k, n in enumerate([1, 5, 9, 12, 20, 25, 30, 49, 50, 60])), "", "", " "]
    for _ in range(60):
        texts.append("\n".join(rng.choice(pool) for _ in range(rng.choice([2, 5, 9, 14]))))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.deleted for r in line_dedup.report(frame).collect()}
    want = brute_runs(texts)
    assert want[4] == "0,1,2" and [got[i] for i in range(len(texts))] == want


def test_lines_of_documents_that_repeat_themselves(spark):
    line = "one line of eight words that comes again"
    texts = ["\n".join([line] * 30_000), "\n".join([line, ""] * 5_000), "\n".join(f"{line} {k // 2}" for k in range(20_000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_deleted) for r in line_dedup.report(frame).collect()}
    # What is equal one line, or two, before goes; lines that come in pairs are too short for a run.
    assert got == {0: (30_000, 29_999), 1: (10_000, 9_998), 2: (20_000, 0)}


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    luhn = sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (c > "4") for k, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".") if kind == "ip"), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_personal_data(spark, docs, empty):
    texts = [f"Please call phone: +1 (555) 010-{i:04d} or mail user{i}@ex{i}.org now. a.b@c.d_e@f.gh 1.2.3.4.5.6.7.8 é1.2.3.4 4111 1111 1111 1111, 999.1.1.1 +12((( 3" for i in range(12)]
    texts += ["Please call phone: (555) 019-2837 today", None, "", "call phone: nothing", "9" * 3000, "@" * 3000, "a" * 30000, "a@b.c" * 300, "x call phone: 555-019-2837 x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if valid(k, m[0])] for k, p in KINDS]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == list(map(len, spans))
        assert r.base_sha256 == hashlib.sha256(",".join(sum(spans, [])).encode()).hexdigest()
        assert set(sum(spans, [])) <= set(r.spans.split(","))
    assert got[12].spans == "phone:19:33" and got[20].spans == "phone:14:26" and got[15].n_found == 0
    assert pii.report(docs).count() == len(corpus()) and pii.report(empty).count() == 0


def test_found_values_induce_further_patterns(spark):
    number = lambda k: f"(555) 019-{k:04d}"
    texts = [f"my phone: +1 (555) 010-{k:04d} ok" for k in range(6)] + [f"my phone: {number(k)} ok" for k in range(6)]
    texts += [f"a mobile {number(k)} ok" for k in [*range(5), *range(10, 15)]] + [f"the cell {number(k)} ok" for k in [*range(10, 15), 20]]
    texts += [f"our fon +49 (30) 1000-{k:04d} ok" for k in range(5)] + [f"our fon {number(k)} ok" for k in range(30, 60)]
    texts += [f"an order {k}x{k}/7 ok" for k in range(20)] + [f"an order {number(k)} ok" for k in range(5)]
    got = [r.spans for r in sorted(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
    place = lambda t: re.search(r"\+[0-9 ()-]+[0-9]|\([0-9 ()-]+[0-9]", t)
    assert got == ["" if "order" in t else f"phone:{place(t).start()}:{place(t).end()}" for t in texts]


def brute_bootstrap(seeds, candidates, least, sure):
    """Trusted (pattern, kind) with their confidence, from (kind, value, patterns) and (value, patterns), round by round."""
    fit = lambda k, v: re.search(pii.SHAPES[k], v) is not None
    edges, known = collections.defaultdict(set), {}
    for kind, value, patterns in seeds:
        known[value] = min((kind, 1.0), known.get(value, (9, 1.0)))
        for p in patterns:
            edges[p].add(value)
    for value, patterns in candidates:
        for p in patterns:
            edges[p].add(value)
    while True:
        trusted = {}
        for p, values in edges.items():
            for k in range(len(pii.KINDS)):
                mine = [known[v][1] for v in values if v in known and known[v][0] == k]
                against = sum(known[v][0] != k if v in known else not fit(k, v) for v in values)
                if len(mine) >= least and sum(mine) / (len(mine) + against) >= sure:
                    trusted[p, k] = sum(mine) / (len(mine) + against)
        more = {}
        for (p, k), c in trusted.items():
            for v in edges[p]:
                if v not in known and fit(k, v):
                    more[v] = max(more.get(v, (0, 9)), (c, -k))
        if not more:
            return trusted
        known |= {v: (-k, c) for v, (c, k) in more.items()}


def test_bootstrap_scores_are_those_of_brute_force(spark):
    from veldt.llm.common import Stage

    rng = random.Random(12)
    words = [f"w{c}" for c in "abcdefgh"]
    made = [lambda k: f"u{k}@x.org", lambda k: f"10.0.0.{k}", lambda k: f"4111 1111 1111 {k:04d}", lambda k: f"+1 555 010-{k:04d}", lambda k: f"Key{k:014d}z"]
    rows = []
    for k in range(400):
        kind = rng.randrange(5)
        left = " ".join([rng.choice(words), rng.choice(words), words[kind] if rng.random() < 0.8 else rng.choice(words)])
        rows.append((kind if rng.random() < 0.4 else 5, made[kind](rng.randrange(60)), left, rng.choice(words)))
    frame = spark.createDataFrame(rows, "kind int, value string, left string, right string")
    contexts = frame.select("kind", "value", pii._contexts(F.col("left"), F.col("right")).alias("p")).collect()
    got = pii.bootstrap(frame.filter("kind < 5"), frame.filter("kind = 5").drop("kind"), Stage(spark, "t"), 5, 0.6).collect()
    want = brute_bootstrap([(r.kind, r.value, r.p) for r in contexts if r.kind < 5], [(r.value, r.p) for r in contexts if r.kind == 5], 5, 0.6)
    assert len(want) > 3 and {(r.pattern, r.kind): round(r.confidence, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_hidden_keys_of_a_table_are_found_by_their_contexts(spark):
    from veldt.llm.common import Stage

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = F.col("value").rlike("^[0-9a-f]{40}$") & (F.crc32(F.col("value").cast("binary")) % 5 == 0)
    keys = {m for r in docs.collect() for m in re.findall(r"(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])", r.text or "") if zlib.crc32(m.encode()) % 5 == 0}
    found = pii.spans(docs, Stage(spark, "t"), hidden=hidden)[1].filter("kind = 4 and not base").select("value").collect()
    assert keys and keys <= {r.value for r in found}


def test_toxicity_separates_held_out_texts(spark, docs, empty):
    rng = random.Random(9)
    bad = ["grumbolt", "snarfling", "vexcroft"]
    rows = []
    for i in range(600):
        words = prose(rng, 60).split(" ")
        if i % 3 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(toxicity.labelled(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")))
    got = {r.doc_id: r for r in toxicity.classify(frame, model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, _, y in test) >= 0.95 * len(test)
    odd = toxicity.classify(docs, model).collect()
    assert len(odd) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert toxicity.classify(empty, model).count() == 0 and toxicity.learn([(b"x", 0)]).score(b"") == 0.0


def test_toxicity_scores_are_those_of_plain_compression(spark, docs):
    import zstandard

    rng = random.Random(4)
    rows = [(i, prose(rng, 40) + (" zorgling vexcroftly" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = toxicity.labelled(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    model = toxicity.learn(sample)
    assert sample.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    assert b"zorgling" in model.toxic and b"zorgling" not in model.ordinary

    def length(side, window):
        how = zstandard.ZstdCompressionParameters.from_level(12, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        held = zstandard.ZstdCompressionDict(side + bytes(range(1, 25)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(window + bytes(range(1, 25))))

    def score(text):
        words = re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        pairs = [(length(model.ordinary, w), length(model.toxic, w)) for w in ([b" " + x[k : k + 64] + b" " for x in words for k in range(0, len(x), 64)] or [b" "])]
        base, saved = length(model.toxic, b" "), [o - t for o, t in pairs]
        counts = [sum(s >= k for s in saved) for k in range(1, 9)] + [sum(s >= k and t <= base + 3 for s, (_, t) in zip(saved, pairs, strict=True)) for k in range(1, 9)]
        x = np.array([math.log1p(c) for c in counts] + [c / len(pairs) for c in counts] + [math.log1p(len(pairs))])
        return 1 / (1 + math.exp(-(model.weights[0] + ((x - model.mean) / model.spread) @ model.weights[1:])))

    some = [(i, t) for i, t, _ in corpus() if i is not None and (t is None or len(t) < 600)][:25] + [(1000 + i, t) for i, t, _ in rows[:8]]
    got = {r.doc_id: r.score for r in toxicity.classify(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    assert all(abs(got[i] - score(t)) < 1e-9 for i, t in some)


def test_toxicity_on_held_out_documents_of_a_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(toxicity.labelled(docs, labels), toxicity.toxic_share(labels))
    test = toxicity.classify(docs, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("toxic", "score", "predicted").collect()
    up, down = ([r.score for r in test if r.toxic == k] for k in (1, 0))
    area = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
    assert area > 0.8 and sum(r.predicted for r in test if r.toxic == 0) <= 0.05 * len(down)


def brute_contamination(texts, items):
    word, low = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(low))
    windows = collections.defaultdict(set)
    for name, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(name))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((len(w), len(hit), ",".join(sorted(found))))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 400])
def test_contamination(spark, docs, empty, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 300)
    rng = random.Random(2)
    base = [t for _, t, _ in corpus() if t and len(t.split()) > 60]
    items = [(k, " ".join(base[k].split()[5 : 5 + 4 * k + 3])) for k in range(6)] + [(6, "One, TWO three!"), (7, None), (8, ""), (9, "nowhere " + prose(rng, 30)), (3, "three"), (10, " ".join(base[0].split()[2:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(docs, bench, ["doc_id"], block_bytes=block_bytes).select("doc_id", "n_words", F.aggregate("spans", F.lit(0), lambda n, s: (n + s["end"] - s["start"]).cast("int")).alias("hit"), F.array_join(F.array_sort(F.array_distinct("items")), ",").alias("items")).collect()
    want = brute_contamination([t for _, t, _ in corpus()], items)
    assert sorted((str(r.doc_id), r.n_words, r.hit, r.items) for r in found) == sorted((str(i), *w) for (i, _, _), w in zip(corpus(), want, strict=True))
    kept = decontaminate.remove(docs, bench)
    assert kept.count() == sum(w[1] == 0 for w in want) and kept.columns == docs.columns
    assert decontaminate.matches(docs, bench.limit(0), ["doc_id"]).filter("size(items) > 0").count() == 0 and decontaminate.matches(empty, bench, ["doc_id"]).count() == 0


@pytest.mark.parametrize("block_bytes", [16 << 20, 60])
def test_contamination_by_items_without_id(spark, block_bytes):
    passage = " ".join(f"w{k}" for k in range(12))
    frame = spark.createDataFrame([(0, f"a b {passage} c"), (1, "a b c"), (2, f"named one two {passage}")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, passage), (None, None), (7, "named one two"), (None, " ".join(f"z{k}" for k in range(40)))], "item_id long, text string")
    assert block_bytes > 60 or len(list(decontaminate._blocks(bench, block_bytes))) > 1
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.matches(frame, bench, ["doc_id"], block_bytes=block_bytes).select("doc_id", hits, "items").collect()}
    assert got == {0: (12, []), 1: (0, []), 2: (15, ["7"])}
    assert [r.doc_id for r in decontaminate.remove(frame, bench).collect()] == [1]


def test_longest_match():
    tests = decontaminate.Suffixes.of([("i", b"a b c d e f g h i j k l m")], 10)
    words = np.array([tests.number.get(w, 0) for w in b"x a b c d e f g h i j k l z".split()] + [0])
    hits = decontaminate.search(words, tests)
    assert [(p, list(at)) for _, p, at in hits] == [(0, [1]), (1, [2]), (2, [3])]
    assert decontaminate.longest(words, tests.texts[0], 0, np.array([1]), 10).tolist() == [12]


def test_longest_matches_are_those_of_brute_force(spark):
    rng = random.Random(21)
    words = [f"v{k}" for k in range(6)]
    texts = [[rng.choice(words) for _ in range(rng.choice([0, 5, 30, 60]))] for _ in range(30)]
    items = [(k, " ".join(t[3 : 3 + n])) for k, (t, n) in enumerate(zip(texts, [2, 9, 10, 14, 25, 40] * 5, strict=True))] + [(99, "v0 v1 v2")]
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(frame, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()}
    for k, d in enumerate(texts):
        best, cover = 0, set()
        for _, item in items:
            w = item.split()
            for i in range(len(d)):
                for j in range(len(w)):
                    n = 0
                    while i + n < len(d) and j + n < len(w) and d[i + n] == w[j + n]:
                        n += 1
                    if n and n >= min(10, len(w)):
                        best, cover = max(best, n), cover | set(range(i, i + n))
        assert got[k].longest == best and {x for s in got[k].spans for x in range(s.start, s.end)} == cover


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a.example/x?y=1#z", "<p>same</p>"), (3, "http://b.example", "<p>same</p>"), (9, "bad\r\nurl", "line\r\n\r\nWARC/1.1\r\n é"), (1, None, None), (2, "http://c.example/", ""), (7, "http://d.example/", "<p>same</p>"), (7, "http://d.example/", "<p>same</p>"), (None, "http://n.example/", "<p>same</p>"), (None, "http://n.example/", "alone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    warc.write(pages, f"file://{tmp_path}/w")
    got = warc.assemble(warc.read(spark, f"file://{tmp_path}/w")).collect()
    assert len(got) == len(rows) and all(r.request and r.response and r.metadata for r in got)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"<p>same</p>": 3, "": 1}
    want = []
    for i, _, t in rows:
        f = first.get(t or "")
        again = f is not None and f != i
        want.append((str(i), len((t or "").encode()), sha(t), "revisit" if again else "response", str(f if again else None)))
    assert sorted((str(r.metadata.page_id), r.response.payload_bytes, r.response.payload_digest, r.response.kind, str(r.metadata.refers_to)) for r in got) == sorted(want)
    warc.write(pages, f"file://{tmp_path}/v", min_bytes=12)
    assert {r.kind for r in warc.read(spark, f"file://{tmp_path}/v").collect()} == {"request", "response", "metadata"}
    payloads = [bytes(r.payload) for r in warc.read(spark, f"file://{tmp_path}/v", True).collect() if r.kind == "response"]
    assert sorted(payloads) == sorted((t or "").encode() for _, _, t in rows)


def test_concurrent_to_in_either_direction(spark):
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("r2", "response", "q2"), ("q2", "request", None), ("m3", "metadata", "gone")]
    frame = spark.createDataFrame(rows, "record_id string, kind string, concurrent_to string")
    got = {r.capture_id: (r.request and r.request.record_id, r.response and r.response.record_id, r.metadata and r.metadata.record_id) for r in warc.assemble(frame).collect()}
    assert got == {"r1": ("q1", "r1", None), "r2": ("q2", "r2", None), "gone": (None, None, "m3")}


def test_transactions_have_all_their_records(spark):
    rows = [("r1", "response", []), ("q1", "request", ["r1"]), ("q2", "request", ["x", "r1"]), ("m1", "metadata", ["q2"]), ("m2", "metadata", ["m1"]), ("r2", "revisit", ["q3", "m3"]), ("q3", "request", []), ("m3", "metadata", None), ("m4", "metadata", ["q5"]), ("q5", "request", [])]
    got = {r.capture_id: ([x.record_id for x in r.requests], r.response and r.response.record_id, [x.record_id for x in r.metadata_records]) for r in warc.assemble(spark.createDataFrame(rows, "record_id string, kind string, concurrent_to array<string>")).collect()}
    assert got == {"r1": (["q1", "q2"], "r1", ["m1", "m2"]), "r2": (["q3"], "r2", ["m3"]), "q5": (["q5"], None, ["m4"])}


def test_archives_of_others(spark, tmp_path):
    def record(kind, name, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    whole = record("warcinfo", "i", b"x: y") + record("response", "r", http) + record("metadata", "m", b"a: b", "WARC-Concurrent-To: <q>", "WARC-Concurrent-To: <r>") + record("response", "w", http, "WARC-Payload-Digest: sha1:WRONG")
    import gzip

    (tmp_path / "crawl.warc").write_bytes(whole)
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record("response", "c", http)) + gzip.compress(b"WARC/1.0\r\nno end"))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = {r.record_id: r for r in warc.read(spark, f"file://{tmp_path}", True).collect()}
    assert set(got) == {"<i>", "<r>", "<m>", "<w>", "<c>", None} and bytes(got["<r>"].payload) == b"body" and got["<r>"].payload_bytes == 4
    assert got["<m>"].concurrent_to == ["<q>", "<r>"] and "digest" in got["<w>"].problem and "no record" in got[None].problem
    assert {r.capture_id: len(r.metadata_records) for r in warc.assemble(warc.read(spark, f"file://{tmp_path}")).collect()} == {"<i>": 0, "<r>": 1, "<w>": 0, "<c>": 0}


def test_archives_refer_and_are_bounded(spark, tmp_path):
    rows = [(f"p{k}", f"http://x/{k}", "same" if k % 3 == 0 else f"page {k} " * 200) for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w", file_bytes=20_000)
    records = warc.read(spark, f"file://{tmp_path}/w").collect()
    first = next(r.record_id for r in records if r.kind == "response" and r.payload_bytes == 4)
    assert len(list((tmp_path / "w").glob("*.gz"))) == 10 and {r.refers_to_record for r in records if r.kind == "revisit"} == {first}
    got = warc.assemble(warc.read(spark, f"file://{tmp_path}/w")).collect()
    assert sorted(r.metadata.page_id for r in got) == sorted(r[0] for r in rows) and {r.metadata.refers_to for r in got if r.response.kind == "revisit"} == {"p0"}
    warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.assemble(warc.read(spark, f"file://{tmp_path}/e")).count() == 0


def test_token_files(spark, docs, empty, monkeypatch):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    ids = [([*whole.encode(t or "", add_special_tokens=False).ids, 1], i) for i, t, _ in corpus()]
    got = sorted(token_store.store(docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for _, i in ids), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), crc(x)) for x, i in ids)
    assert token_store.store(empty, path).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(4).integers(0, 300, 3000).astype(np.uint16)
    w = token_store.Wavelet(token_store.write_shard(2, 1, [4, None], [1000, 2000], ids))
    assert (w.tokens() == ids).all() and w.doc_ids == [4, None] and w.sizes.tolist() == [1000, 2000] and (w.shard, w.part) == (2, 1)
    for i in range(0, 3000, 97):
        assert w.access(i) == ids[i]
    for t in (0, 7, 299, 400):
        where = np.flatnonzero(ids == t)
        assert w.count(t) == len(where) and w.rank(t, 1234) == (where < 1234).sum()
        assert [w.select(t, k) for k in range(len(where))] == where.tolist()
        with pytest.raises(IndexError):
            w.select(t, len(where))


def test_mixing(spark, docs, empty):
    def fill(sizes, total):
        weight, cap, target = [(5, 2, 1)[k % 3] for k in range(len(sizes))], [2 * s for s in sizes], [0.0] * len(sizes)
        fixed = set()
        while True:
            rest, w = total - sum(cap[k] for k in fixed), sum(weight[k] for k in range(len(sizes)) if k not in fixed)
            target = [cap[k] if k in fixed else rest * weight[k] / w for k in range(len(sizes))]
            over = {k for k in range(len(sizes)) if k not in fixed and target[k] > cap[k]}
            if not over:
                return target
            fixed |= over

    size = lambda t: len(WORD.findall(t or ""))
    totals = collections.Counter()
    for _, t, s in corpus():
        totals[s] += size(t)
    order = sorted(totals, key=lambda s: (s is None, s))
    want = dict(zip(order, fill([totals[s] for s in order], 1.5 * sum(totals.values())), strict=True))
    from veldt.llm.common import Stage

    sizes, aims = mixing.plan(docs, Stage(spark, "t"))
    got = {r.source: (r.source_size, r.target) for r in aims.collect()}
    assert {s: v[0] for s, v in got.items()} == totals and all(abs(got[s][1] - want[s]) < 1e-6 * (1 + want[s]) for s in want)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.source] += size(r.text)
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 5 for s in want)
    assert mixing.mix(docs).count() == mixed.count() and mixing.mix(empty).count() == 0


def test_wavelet_matrix_of_many_blocks_unpacks_few():
    ids = np.random.default_rng(5).integers(0, 50_000, 200_000).astype(np.uint16)
    w = token_store.Wavelet(token_store.write_shard(0, 0, [1], [200_000], ids))
    assert [w.access(i) for i in (0, 65_535, 65_536, 131_072, 199_999)] == ids[[0, 65_535, 65_536, 131_072, 199_999]].tolist() and len(w.held) <= 80
    where = np.flatnonzero(ids == ids[777])
    assert w.count(int(ids[777])) == len(where) and [w.select(int(ids[777]), k) for k in range(len(where))] == where.tolist()
    assert (w.tokens() == ids).all()


def test_token_files_refuse_ids_they_cant_hold(docs):
    public = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError, match="whole number"):
        token_store.store(docs.withColumn("doc_id", F.col("doc_id").cast("string")), public.path("word_bpe_49k.json"))


def test_tokenizers_that_look_across_blanks_encode_whole_texts(docs):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    encoder, whole = token_store.Encoder(path), tokenizers.Tokenizer.from_file(path)
    texts = [t or "" for _, t, _ in corpus()]
    assert encoder.whole and not token_store.Encoder.of(public.path("word_bpe_49k.json")).whole
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.batch([t.encode() for t in texts])] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_words_are_encoded_once_whatever_marks_they_stand_with():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    whole, rng = tokenizers.Tokenizer.from_file(path), random.Random(7)
    marks = [".", ",", "***", "%%%", "'", "='", "\u0338=", ""]
    words = ["ende", "größe", "naß", "where", "İ", "×", "don't", "東京", "a1", "é\u0301", "—", "<b>", "ŉ"]
    texts = [None, "", " \n", *("".join(rng.choice([*words, *marks, " "]) for _ in range(30)) for _ in range(300))]
    encoder = token_store.Encoder(path)
    ids, sizes = encoder.column(pa.array(["before", *texts]).slice(1))
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    encoder = token_store.Encoder(path)
    encoder.column(pa.array([f"{b}{w}{a}" for w in ("ende", "größe", "naß") for b in ("(", "**") for a in (".", ",", "***", "'")]))
    assert {p.decode() for p in encoder.known} == {"ende", "größe", "naß", "(", "**", ".", ",", "***", "'"}


def test_scopes_delete_what_was_staged(spark, docs, tmp_path):
    from veldt.llm import common

    outer, paths = common.Stage(spark, "outer", held=True), []
    with common.scope(spark):
        inner = common.Stage(spark, "inner")
        inner.put("a", docs), outer.put("b", docs)
        paths += [inner.paths["a"], outer.paths["b"]]
    exists = [spark._jvm.java.io.File(p.removeprefix("file://")).exists() for p in paths]
    assert exists == [False, True]


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [1, 1, 1], [0, 50, 7, 9, 100], [5]])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    rows = mixing.targets(frame).collect()
    assert abs(sum(r.target for r in rows) - 1.5 * sum(sizes)) < 1e-6 and all(r.target <= 2 * r.source_size + 1e-9 for r in rows)
