"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ordina.llm import classifier, common, components, exact_dedup, html_extract, licenses, minhash, mixing, packing, quality_rules, substring, token_counts, tokenizing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n long, norm string, m int, c int, tokens string, row string, kept string, component_id string, domain string, key string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, repeats within a text, blanks of all kinds, odd rows."""
    rng = random.Random(3)
    texts = []
    passage = " ".join(words(rng, 60))
    for i in range(60):
        base = words(rng, rng.choice([3, 8, 40, 120, 300]))
        texts.append(" ".join(base))
        if i % 5 == 0:
            for _ in range(4):
                near = list(base)
                near[rng.randrange(len(near))] = "changed"
                texts.append(" ".join(near))
        if i % 6 == 0:
            texts.append(" ".join(base).upper())
        if i % 7 == 0:
            texts.append(" ".join(words(rng, 30)) + "\n" + passage + "\t" + " ".join(words(rng, 20)))
    texts += ["", None, "   ", "one", "one two", "a  b   c\n\n d ", "Ünï cödé x ÄÖ", "x" * 5000, "spam ham " * 400, " ".join(words(rng, 20000, 5000)), "tab\x0b\x0cfeed", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|><|endoftext|>c <|endof text|>"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    made = [(i, t, ("en", "de", None)[k % 3], ("src0", "src1", None, "src2")[k % 4], None if t is None else len(t), *["x", 1, "x", 1, 1, "x", "x", "x", "x", "x", "x"]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, one id with two texts."""
    text = "the same words come again and again in this row of many words " * 5
    return frame(spark, [(None, "a b c"), (None, None), (7, text), (7, text), (8, text), (9, "a b c"), (9, "other"), (10, None)])


def lower(t):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")


def split(t):
    return (t or "").encode().split()


def test_exact(docs, rows, odd):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = {i: (max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows}
    assert {r[0]: tuple(r[1:]) for r in exact_dedup.exact_groups(docs).collect()} == want
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i in want if want[i][2])
    made = exact_dedup.exact_groups(odd).collect()
    assert sum(r.kept for r in made) == 4 and len(made) == 8
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(odd).select("doc_id").collect()) == [8, 9, 9, 10]


@pytest.mark.parametrize("most", [1000, 3])
def test_exact_hot_groups(spark, monkeypatch, most):
    """A hot group, with groups looked up by broadcast and by joins."""
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    monkeypatch.setattr(common, "FEW_ROWS", most)
    hot = frame(spark, [(i, "Same Text" if i % 2 else f"text {i // 4}") for i in range(60)] + [(99, None)] * 30 + [(None, "lone"), (None, "lone")])
    made = exact_dedup.exact_groups(hot).collect()
    assert Counter((r.keep_id, r.group_size) for r in made if r.group_size > 2) == {(59, 30): 30, (99, 30): 30}
    assert sum(r.kept for r in made) == 18
    kept = exact_dedup.drop_exact(hot)
    assert kept.columns == hot.columns and sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, *range(2, 60, 4), 59, 99]


def test_exact_collisions(spark, monkeypatch):
    """Texts of equal digests are told apart by their bytes."""
    monkeypatch.setattr(exact_dedup, "_digests", lambda norm: (F.encode(F.char_length(norm).cast("string"), "utf-8"), F.left(norm, F.lit(1))))
    df = frame(spark, [(1, "aa"), (2, "ab"), (3, "AA"), (4, "b"), (5, "ab"), (6, "abc")])
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()} == {1: (3, 2), 2: (5, 2), 3: (3, 2), 4: (4, 1), 5: (5, 2), 6: (6, 1)}
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(df).select("doc_id").collect()) == [3, 4, 5, 6]


def test_names_that_operators_use_themselves(spark):
    """Columns of the caller's may have any name, and come out as they are."""
    names = ["row", "k", "id", "h", "more", "keep_id", "group_size", "__id", "__sha", "__bad", "__gone", "text_sha256", "carried", "kept", "m"]
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(i, t, "en", "s", *["mine"] * len(names)) for i, t in ((1, text), (2, text.upper()), (3, text + " end"), (None, "other words " + text[::-1]))], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for made, ids in ((exact_dedup.drop_exact(df), [2, 3, None]), (minhash.drop_near(df), [1, None]), (quality_rules.keep_good(df), [1, 3]), (mixing.take(df, {"lang": "lang"}, {}, share=1.0), [1, 2, 3, None])):
        rows = made.collect()
        assert made.columns == df.columns and {r.doc_id for r in rows} == set(ids) and len(rows) == len(ids)
        assert all(r[n] == "mine" for r in rows for n in names)


def brute_near(rows, size, percent=80):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in split(t)]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    low = list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                low[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("size", [4, 5])
def test_near(docs, rows, size):
    assert {r[0]: tuple(r[1:]) for r in minhash.near_groups(docs, shingle=size).collect()} == brute_near(rows, size)


def test_near_large_nodes(docs, rows, monkeypatch):
    """Small nodes and blocks: branching on several levels and blocks of one group give the same groups."""
    monkeypatch.setattr(minhash, "NODE", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(components, "LOCAL_EDGES", 2)
    assert {r[0]: tuple(r[1:]) for r in minhash.near_groups(docs, shingle=4).collect()} == brute_near(rows, 4)


def test_near_odd(docs, odd):
    made = minhash.near_groups(odd, shingle=4).collect()
    assert len(made) == 8 and all(r.component_id is None and not r.kept for r in made if r.doc_id is None)
    assert {r.component_id for r in made if r.doc_id in (7, 8)} == {7}
    assert minhash.drop_near(docs).columns == docs.columns


def test_components(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(4, 4)] + [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(40)]
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    df = spark.createDataFrame(edges, "u long, v long")
    for limit in (1000, 3):
        monkeypatch.setattr(components, "LOCAL_EDGES", limit)
        assert dict(map(tuple, components.components(df).collect())) == want
        assert components.components(df.limit(0)).count() == 0


def brute_repeats(rows, window=35):
    seen = Counter(tuple(w[i : i + window]) for _, t in rows for w in [split(t)] for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def test_substring(docs, rows, odd, monkeypatch):
    want = brute_repeats(rows)
    assert Counter(map(tuple, substring.remove_repeats(docs).collect())) == want
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    for most in (1, 2):  # every bucket of several strings is large, at the next level too
        monkeypatch.setattr(substring, "BUCKET_STRINGS", most)
        assert Counter(map(tuple, substring.remove_repeats(docs).collect())) == want
    made = Counter(map(tuple, substring.remove_repeats(odd).collect()))
    assert made == brute_repeats([(r.doc_id, r.text) for r in odd.collect()])


def test_substring_common_phrases(spark, monkeypatch):
    """Phrases as long as each level's minimisers in ever other surroundings, repeated windows among them."""
    rng = random.Random(41)
    phrases = [" ".join(words(rng, n, 10**6)) for n in (8, 12, 20, 24, 34, 40)]
    rows = [(i, " ".join(" ".join(words(rng, rng.randint(5, 40), 10**6)) + " " + rng.choice(phrases) for _ in range(4))) for i in range(60)]
    rows += [(100 + i, t + " tail " + rng.choice(phrases)) for i, (_, t) in enumerate(rows[:10])]
    monkeypatch.setattr(substring, "BUCKET_STRINGS", 3)
    assert Counter(map(tuple, substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_repeats(rows)


def brute_measures(t):
    w = split(t)
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum(x in "#*$%&|<>" for x in t or ""), dup, len(hit)


def test_quality(spark, docs, rows, odd):
    made = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in rows:
        want = brute_measures(t)
        assert tuple(made[i][1:6]) == want
        assert made[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (made[i].kept and made[i].base_failed)
    assert quality_rules.judge(odd).count() == 8
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in made.values())
    rng = random.Random(1)
    clean = [(i, " ".join(words(rng, 50))) for i in range(300)]
    junk = [(1000 + i, " ".join("|" if k % 2 else w for k, w in enumerate(words(rng, 50)))) for i in range(9)] + [(2000, "SHOUT!! " + " ".join(w.upper() + "!!" for w in words(rng, 50)))]
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, clean + junk)).collect()}
    assert all(verdict[i] for i, _ in clean) and not any(verdict[i] for i, _ in junk)


def test_thresholds_follow_their_group(spark):
    rng = random.Random(2)
    row = lambda i, source, share: (i, " ".join(w + ("#" if rng.random() < share else "") for w in words(rng, 100)), "en", source, 1)
    table = [row(i, "plain", 0.001) for i in range(250)] + [row(1000 + i, "marked", 0.3 + 0.1 * rng.random()) for i in range(250)] + [row(9, "plain", 0.4)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(kept[1000 + i] for i in range(250))


def test_sketched_limits_decide(spark):
    """Outliers of their group fall at a value that is usual in another group; repeats fall below the base rule."""
    rng = random.Random(12)
    text = lambda size, n=100: " ".join("".join(rng.choices("abcdefghij", k=size + rng.randrange(3))) for _ in range(n))
    shout = lambda: "".join(x.upper() if rng.random() < 0.3 else x for x in text(5))
    part = text(5, 8)
    odd = [(1, text(11), "short"), (2, shout(), "short"), (3, f"{part} {text(5, 84)} {part}", "short"), (4, text(11), "long"), (5, shout(), "loud")]
    table = odd + [(1000 + i, text(5), "short") for i in range(220)] + [(2000 + i, text(11), "long") for i in range(220)] + [(3000 + i, shout(), "loud") for i in range(220)]
    df = spark.createDataFrame([(i, t, "en", source, len(t)) for i, t, source in table], "doc_id long, text string, lang string, source string, n_chars long")
    made = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert [made[i].broken for i in (1, 2, 3)] == [["mean_word"], ["upper_ratio"], ["repeat_ratio"]] and not any(made[i].base_failed for i in (1, 2, 3))
    assert all(r.kept for i, r in made.items() if i > 3)


def exact_limits(table, slack):
    """ratio -> (lang, source) -> limit by sorted values, each quartile moved by ``slack`` of the ranks."""
    def value(m, top, bottom, unit):
        return (m[top] + unit) / (m[bottom] + 2 * unit) if unit else m[top] / m[bottom] if m[bottom] else 0.0

    out = {}
    for ratio, (top, bottom, unit) in quality_rules.RATIOS.items():
        groups = defaultdict(list)
        for m in table:
            for key in ((m["lang"], m["source"]), (m["lang"],), ()):
                groups[key] += [] if m["failed"] else [value(m, top, bottom, unit)]

        def quartile(key, p, ratio_groups=groups):
            own = sorted(ratio_groups[key])
            return own[min(len(own) - 1, max(0, math.ceil(p * len(own)) - 1))] if own else 0.0

        width = lambda key: quartile(key, 0.75 - slack) - quartile(key, 0.25 + slack)
        shrunk = lambda own, n, parent: (n * own + quality_rules.PRIOR_ROWS * parent) / (n + quality_rules.PRIOR_ROWS)
        pairs = [g for g in groups if len(g) == 2]

        def high(key):
            own = quartile(key, 0.75 - slack)
            return shrunk(own, len(groups[key]), high(key[:-1])) if key else own

        def mean(key):
            below = [g for g in pairs if g[: len(key)] == key]
            n = sum(len(groups[g]) for g in below)
            return shrunk(sum(len(groups[g]) * width(g) for g in below) / max(1, n), n, mean(key[:-1]) if key else width(key))

        for key in pairs:
            out[ratio, key] = high(key) + quality_rules.SPREAD * max(width(key), mean(key[:1]))
    return out


def test_limits_against_exact_quantiles(spark):
    """Each limit lies between those of quartiles a few ranks nearer together and farther apart, and kept follows it."""
    rng = random.Random(31)
    marks = lambda w: w + rng.choice(["", "", "", "!", "#", "*"]) if rng.random() < 0.2 else w
    rows = []
    for i in range(1500):
        lines = [" ".join(marks(w if rng.random() < 0.8 else w.title()) for w in words(rng, rng.randint(2, 30))) for _ in range(rng.randint(1, 8))]
        rows.append((i, "\n".join(lines + (lines[:1] if rng.random() < 0.1 else [])), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    table = [{**made[i].asDict(), "lang": lang or "\x00", "source": source or "\x00", "failed": made[i].base_failed} for i, _, lang, source, _ in rows]
    near, far = exact_limits(table, 0.03), exact_limits(table, -0.03)
    verdicts = Counter()
    for m in table:
        for ratio, (top, bottom, _) in quality_rules.RATIOS.items():
            value, key = m[top] / m[bottom] if m[bottom] else 0.0, (ratio, (m["lang"], m["source"]))
            assert near[key] <= far[key]
            if not near[key] <= value <= far[key]:
                assert (ratio in m["broken"]) == (value > far[key])
                verdicts[ratio in m["broken"]] += 1
        assert m["kept"] == (not m["base_failed"] and not m["broken"])
    assert verdicts[True] > 5 and verdicts[False] > 5000


def test_copies_do_not_narrow_limits(spark):
    """A source of near copies leaves no spread; clean documents in it are judged by what is usual elsewhere."""
    rng = random.Random(17)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 200)))
    one = text().split()
    near = lambda i: " ".join([*one[: i % 40], "changed", *one[i % 40 :]])
    rows = [(i, near(i) if i % 20 else text(), "hot") for i in range(600)] + [(1000 + i, text(), f"s{i % 4}") for i in range(600)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made = [r.kept for r in quality_rules.judge(df).collect()]
    assert sum(made) >= 0.99 * len(made)


def test_quality_keeps_odd_rows(spark):
    """Rows without an id, with a repeated one, and columns of any name: each row is judged by itself."""
    good, bad = "a row of more than ten words that are all different from each other here", "too few"
    df = spark.createDataFrame([(None, good, "en", "s", 1, 2), (7, good, None, None, 3, 4), (7, bad, "en", "s", 5, 6), (None, bad, "en", "s", 7, 8)], "doc_id long, text string, lang string, source string, carried int, kept int")
    made = quality_rules.keep_good(df)
    assert made.columns == df.columns and sorted(r.carried for r in made.collect()) == [1, 3]


def test_packing(docs, rows, odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = packing.pack(docs, sequence=64).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in made:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and 0 < r.length <= 64 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(odd).count() == 8


def test_packing_deals_out_repeated_ids(spark):
    """Rows that share an id are dealt into several groups, and fill their sequences."""
    rng = random.Random(21)
    texts = [(5, " ".join(words(rng, rng.randrange(1, 40)))) for _ in range(2000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    made = packing.pack(df, sequence=64, group_pieces=250).collect()
    sizes = Counter(r.sequence_id >> 32 for r in made)
    assert len(sizes) == -(-len(made) // 250) and max(sizes.values()) < 400
    total = sum(r.length for r in made)
    assert total == sum(r.doc_tokens for r in made if r.start == 0) and total / 64 / len({r.sequence_id for r in made}) > 0.97


def test_first_fit_decreasing():
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    made = packing.first_fit_decreasing(lengths, 100)
    free, want = [], {}
    for i in sorted(range(500), key=lambda k: -lengths[k]):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= lengths[i]
    assert made == [want[i] for i in range(500)] and packing.first_fit_decreasing([], 10) == []


@pytest.mark.parametrize("text", ["", " ", "a b", "a  b", "a   b", "\n a", "a \n b", "a b c", "don't we'll x2 !? <|endoftext|>", "tab\t x\n\n\ny z", " lead", "trail ", "trail  "])
def test_unit_encoder(text):
    made = tokenizing.encoder()
    assert made.ids(text) == made.whole(text)


def test_token_counts(docs, rows):
    import public_tokenizers
    import regex

    scores = token_counts.unigram()
    pattern = regex.compile(public_tokenizers.PATTERN)

    def best(piece):
        top = [(0.0, 0)]
        for j in range(1, len(piece) + 1):
            found = (-math.inf, 0)
            for i in range(max(0, j - 128), j):
                s = scores.get(piece[i:j])
                if s is not None and top[i][0] + s > found[0]:
                    found = (top[i][0] + s, top[i][1] + 1)
            top.append(found)
        return top[-1][1]

    known = {}
    for r in token_counts.token_counts(docs).collect():
        found = pattern.findall(dict(rows)[r.doc_id] or "")
        assert r.n_pretokens == len(found)
        assert r.n_tokens == sum(known.setdefault(p, best(p.encode())) for p in found)


def test_token_memory_is_bounded_within_a_text(monkeypatch):
    rng = random.Random(22)
    text = " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(3000)) + " " + "xyz" * 4000 + " " + "!?" * 100
    want = token_counts.Counter("byte_bpe_50k").count(text)
    for name, value in (("NODES", 500), ("UNITS", 50), ("LONG", 20)):
        monkeypatch.setattr(token_counts, name, value)
    counter = token_counts.Counter("byte_bpe_50k")
    assert counter.count(text) == want and len(counter.trie.best) <= 500 + 20 and len(counter.units) <= 50


def test_mixing(docs, odd, spark):
    levels = {"domain": "CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END", "lang": "lang", "source": "source"}
    weights = {("crawl",): 0.2, ("curated", "en"): 3.0}
    made = mixing.mix(docs, levels, weights, share=0.6).collect()
    leaves = defaultdict(list)
    for r in made:
        leaves[r.domain, r.lang, r.source].append(r)
    for own in leaves.values():
        assert sum(r.epochs * r.tokens + r.last_tokens for r in own) == own[0].leaf_budget <= 2 * sum(r.tokens for r in own)
        assert sum(0 < r.last_tokens < r.tokens for r in own) <= 1
    assert sum(own[0].leaf_budget for own in leaves.values()) == int(0.6 * sum(r.tokens for r in made))
    taken = mixing.take(docs, levels, weights, share=0.5)
    assert taken.columns == docs.columns and 0 < taken.count() < docs.count()
    assert mixing.mix(odd, levels, weights).count() == 8
    with pytest.raises(ValueError):
        mixing.mix(docs, levels, {("crawl",): 0})


def test_mixing_prefixes_against_brute_force(spark, monkeypatch):
    """Each leaf's whole epochs, and the row-by-row walk along its last epoch's seeded order."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rng = random.Random(51)
    rows = [(i, rng.choice(["en", "en", "en", "de"]), rng.choice("abc"), rng.choice([0, 1, 7, 50, 400])) for i in range(300)] + [(900, "fr", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n long")
    levels, weights = {"lang": "lang", "source": "source"}, {("de",): 6.0, ("en", "a"): 0.2}
    made = mixing.mix(df, levels, weights, share=0.7, max_epochs=3, seed=5, tokens=F.col("n"))
    made = made.withColumn("order", F.xxhash64(F.lit(5), "epochs", "doc_id")).collect()
    tree = defaultdict(lambda: defaultdict(int))
    for _, lang, source, n in rows:
        tree[lang][source] += 3 * n
    total = int(0.7 * sum(r[3] for r in rows))
    want = brute_budgets({k: dict(v) for k, v in tree.items()}, total, weights)
    leaves = defaultdict(list)
    for r in made:
        leaves[r.lang, r.source].append(r)
    epochs = set()
    for key, own in leaves.items():
        budget, have = own[0].leaf_budget, sum(r.tokens for r in own)
        assert abs(budget - want[key]) <= 3
        left = budget % have if have else 0
        for r in sorted(own, key=lambda r: (r.order, r.doc_id)):
            assert r.epochs == (budget // have if have else 0)
            assert r.last_tokens == min(left, r.tokens)
            left -= r.last_tokens
        assert left == 0
        epochs.add(own[0].epochs)
    assert len(epochs) > 1


def test_mixing_counts_real_tokens(docs, rows, spark):
    """Tokens are the packing vocabulary's, so budgets and prefixes are cut in those, whatever a language needs per byte."""
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = lambda text: len(t.encode(text or "", add_special_tokens=False).ids)
    levels = {"lang": "lang", "source": "source"}
    assert {r.doc_id: r.tokens for r in mixing.mix(docs, levels, {}).collect()} == {i: size(text) for i, text in rows}
    rng = random.Random(14)
    dense = [(i, " ".join(rng.choices(["the", "of", "this", "people"], k=rng.randint(5, 60))), "en") for i in range(80)]
    wide = [(100 + i, " ".join(rng.choices(["ñandúes", "übërgröße", "ção", "żółw"], k=rng.randint(5, 60))), "es") for i in range(80)]
    table = spark.createDataFrame([(i, text, lang, size(text)) for i, text, lang in dense + wide], "doc_id long, text string, lang string, n long")
    made = mixing.mix(table, {"lang": "lang"}, {}, share=0.5, max_epochs=1, tokens=F.col("n")).filter("epochs > 0 OR last_tokens > 0")
    taken = mixing.take(table, {"lang": "lang"}, {}, share=0.5)
    assert sorted(r.doc_id for r in taken.collect()) == sorted(r.doc_id for r in made.collect())


def brute_budgets(tree, total, weights, path=()):
    """Water filling by repeated rounds: full children leave, the others share what is left."""
    if not isinstance(tree, dict):
        return {path: min(total, tree)}
    cap = lambda t: t if not isinstance(t, dict) else sum(map(cap, t.values()))
    open_, given, left = set(tree), {}, float(min(total, cap(tree)))
    while open_:
        share = left / sum(weights.get((*path, k), 1.0) for k in open_)
        full = {k for k in open_ if cap(tree[k]) <= share * weights.get((*path, k), 1.0)}
        for k in full or open_:
            given[k] = cap(tree[k]) if full else share * weights.get((*path, k), 1.0)
        left -= sum(given[k] for k in full)
        open_ = open_ - full if full else set()
    out = {}
    for k in tree:
        out |= brute_budgets(tree[k], given[k], weights, (*path, k))
    return out


def test_budgets(spark):
    rng = random.Random(9)
    tree = {d: {a: {s: rng.choice([0, 5, 100, 3000, 90000]) for s in "xyz"} for a in "pq"} for d in "AB"}
    weights = {("A",): 2.0, ("A", "p"): 5.0, ("B", "q", "x"): 0.5}
    leaves = [(d, a, s, c) for d, t in tree.items() for a, u in t.items() for s, c in u.items()]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, cap long")
    for total in (0, 1000, 60_000, 10**9):
        made = {tuple(r[:3]): r.budget for r in mixing.budgets(df, total, mixing.LEVELS, weights).select(*mixing.LEVELS, "budget").collect()}
        want = brute_budgets(tree, total, weights)
        assert all(abs(made[k] - want[k]) <= 3 for k in want)
        assert sum(made.values()) == min(total, sum(r[3] for r in leaves))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav><div class="ad banner">Buy now</div>
<article><h1>Head  line</h1><p><b>One &lt;two&gt;
 three.<br><p>Four <a href="#">five</a> six.<div class="cookie-notice">We use cookies</div><p title="a > b">Seven &eacute;.</p>
<ul><li>eight</li></ul></article><section id="comments"><p>Nice!</p></section><form>Mail <input name=x></form><aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_html(spark):
    want = "Head line\n\nOne <two> three.\n\nFour five six.\n\nSeven é.\n\neight"
    weights = html_extract.fit([PAGE] * 3)
    assert html_extract.extract(PAGE, weights) == want and html_extract.extract(PAGE, html_extract.Weights()) == want
    assert html_extract.extract(None, weights) == html_extract.extract("<p></p>", weights) == ""
    assert html_extract.extract("plain &amp; simple", weights) == "plain & simple"
    assert html_extract.extract("<p>open <!-- never closed", weights) == "open"
    rows = [(1, "u", PAGE, 1), (None, None, None, 2), (3, "u", "", 3), (3, "u", "", 3), (4, "u", "<p>" + "long text " * 20000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    made = html_extract.extract_pages(pages).collect()
    assert [r.text for r in made][:2] == [want, ""] and made[4].n_chars == 199_999
    assert all(r.n_chars == len(r.text) for r in made) and html_extract.extract_pages(pages.limit(0)).count() == 0


def test_html_elements():
    text = lambda page: html_extract.extract(page, html_extract.Weights())
    assert text("<div class='content with-sidebar'><p>One</p><div class='overflow-hidden'>Two</div><div hidden>Three</div></div>") == "One\n\nTwo"
    assert text("<article class='post legal'><header class='entry-header'><h1>Title</h1></header><p>Text</p></article><article class='comment'>No</article>") == "Title\n\nText"
    assert text("<div id='userComments'>No</div><p>Yes</p><div style='display: none'>No</div>") == "Yes"
    assert text("<p title=\"never closed>One</p><p>Two</p>") == "One\n\nTwo"
    assert text("<div class='ad'>Buy<article><p>One</p></article>") == "One"


def test_html_head_left_open():
    text = lambda page: html_extract.extract(page, html_extract.Weights())
    head = "<html><head><meta charset=x><title>T</title><script>var a = '<body>';</script>"
    for page in (head + "<body><p>One</p><p>Two</p></body>", head + "<p>One</p><p>Two</p>", head + "</head><body><p>One</p><p>Two</p></body>"):
        assert text(page) == "One\n\nTwo"


def test_html_region():
    """Without telling elements, the run of words wins over runs of links."""
    links = "".join(f"<div><a href='/{i}'>link {i}</a></div>" for i in range(20))
    text = "".join(f"<div>{'word ' * 30}end{i}</div>" for i in range(5))
    weights = html_extract.Weights({"a": -3.0, "/a": -3.0})
    assert html_extract.extract(links + text + links, weights).startswith("word") and html_extract.extract(links + text + links, weights).endswith("end4")


def test_best_run():
    """The scan against every run of blocks."""
    rng = random.Random(15)
    for _ in range(400):
        scores = [(rng.choice([0, 0, -1, -3, -20]), rng.choice([1, 2, 5, 30, -2])) for _ in range(rng.randint(0, 12))]
        total = lambda i, j: sum(b + s for b, s in scores[i:j]) - scores[i][0]
        top = max((total(i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        first, end = html_extract.best_run(scores)
        assert (total(first, end) if end else 0) == max(0, top)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_scan_decides(spark):
    """On whole pages, learned weights choose the region: without holes the text is the same, without weights it is not."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_extract.learn(pages)
    assert {"div.ad", "nav", "footer"} <= weights.far and "p" not in weights.far and weights == html_extract.learn(pages.repartition(5).unionByName(pages))
    all_pages = [r.html for r in pages.collect()]
    whole = [html_extract.extract(h, weights, holes=False) for h in all_pages]
    assert whole == [html_extract.extract(h, weights) for h in all_pages]
    assert sum(a != html_extract.extract(h, html_extract.Weights(), holes=False) for a, h in zip(whole, all_pages, strict=True)) > 0.9 * len(all_pages)
    for text, h in zip(whole, all_pages, strict=True):
        article = html_extract.extract(h[h.index("<article") : h.index("</article>")], html_extract.Weights(), holes=False)
        assert text == article


def test_html_repeated_and_long_labelled_pages(spark):
    """Copies of a labelled page teach once, and long ones teach too; a table without labelled pages has the prior."""
    long = PAGE.replace("<li>eight</li>", "<li>eight</li>" + "<p>" + "word " * 20_000)
    df = spark.createDataFrame([(1, "u", PAGE)] * 50 + [(1, "u", long), (None, None, "<p>a</p>")], "page_id long, url string, html string")
    made, want = html_extract.learn(df), html_extract.fit([PAGE, long])
    assert made.tags == pytest.approx(want.tags, abs=0.2) and made.far == want.far
    assert html_extract.learn(df.filter("html = '<p>a</p>'")).tags == html_extract.PRIOR


def test_licenses(spark):
    files = [
        ("LICENSE", "Apache License\nVersion 2.0, January 2004\nApache License Version 2.0, January 2004", 1),
        ("src/a.py", "# Released under the MIT License.\n" + "import os and many more words of code " * 5, 1),
        ("src/b.py", "import os", 1),
        ("src/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3.", 1),
        ("src/vendor/deep/c.py", None, 1),
        ("src/vendor/deep/c.py", None, 1),
        ("docs/x.md", "the rights of all, reserved seats in numbered rows, and a public version of the play", 1),
        (None, "", 1),
    ]
    df = spark.createDataFrame(files, "path string, text string, license int")
    made = {r.path: (r.license, r.origin, r.license_dir) for r in licenses.scan(df).collect()}
    assert made["src/a.py"] == ("MIT", "own", None) and made["src/b.py"] == ("Apache-2.0", "inherited", "")
    assert made["src/vendor/deep/c.py"] == ("GPL", "inherited", "src/vendor") and made["docs/x.md"][1] == "inherited"
    assert licenses.scan(df).count() == 8 and licenses.scan(df.limit(0)).count() == 0


def test_license_scores(spark):
    rng = random.Random(8)
    rows, unknown = licenses.vectors()
    idf = {t: x for _, _, t, _, x in rows}
    vectors = defaultdict(dict)
    for name, i, t, w, x in rows:
        vectors[name, i][t] = w * x
    pool = sorted(idf) + ["foo", "bar"]
    lines = [" ".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(200)]
    lines += [rng.choice(["", "Foo bar. ", "// ", "foo\n\n"]) + t.replace(" ", "\n# ", 1 + i % 3) + rng.choice(["", " And more.", "\nfoo"]) for i, t in enumerate(t for ts in licenses.TEMPLATES.values() for t in ts)]
    df = spark.createDataFrame(list(enumerate(lines)), "key long, text string")
    made = {r.key: (r.license, r.score) for r in licenses.segment_licenses(df).collect()}
    for k, line in enumerate(lines):
        best = (0.0, "")
        for _, part in licenses.segments(line):
            tf = Counter(licenses._terms(part))
            norm = math.sqrt(sum(n * n * (idf[t] ** 2 if t in idf else unknown) for t, n in tf.items())) or 1.0
            best = max(best, max((round(sum(n * v.get(t, 0) for t, n in tf.items()) / norm, 6), name) for (name, _), v in vectors.items()))
        score, name = best
        assert made.get(k) == ((name, pytest.approx(score, abs=1e-5)) if score >= licenses.COSINE else None)


def test_license_notices(spark):
    """Common forms of notices, alone, within prose, wrapped, and beside code; very long texts, ties, clean texts."""
    mit = " ".join(licenses.TEMPLATES["MIT"][-2:])
    wrapped = "\n".join("# " + mit[i : i + 60].strip() for i in range(0, len(mit), 60))
    wanted = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0\nint main() {}": "Apache-2.0", "Copyright 2020 John Smith. All rights reserved.": "proprietary",
        "This project is released under the terms of the MIT License.": "MIT", "Licensed under the MIT license. See LICENSE file in the project root for details.": "MIT",
        "The library is licensed to you under the terms of the MIT license": "MIT", mit: "MIT", wrapped: "MIT", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nEveryone": "GPL",
        "Long prose comes first and says this and that. Licensed under CC BY 4.0. And it goes on with more of that prose": "CC-BY", "word " * 200_000 + ". Licensed under CC BY-SA 4.0.": "CC-BY-SA",
        "the rights of all people are discussed in a version of this work by the author": None, "permission slips and notices of the school are copied here": None, "": None,
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(wanted)], "key long, text string")
    made = {r.key: r.license for r in licenses.segment_licenses(df).collect()}
    assert {t[:60]: made.get(k) for k, t in enumerate(wanted)} == {t[:60]: x for t, x in wanted.items()}
    tie = {"B": ("grants all alpha beta",), "A": ("grants all alpha gamma",)}
    rows = licenses.segment_licenses(spark.createDataFrame([(1, "grants all alpha")], "key long, text string"), tie).collect()
    assert [r.license for r in rows] == ["B"]


def test_classifier(spark, odd):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 60)) if i % 3 else "Junk Junk " * 40, "en", f"src{i % 5}", 300) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 600, 4)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = classifier.train(df, labels)
    made = {r.doc_id: r for r in classifier.score(df, model).collect()}
    held_out = [i for i in range(600) if i % 4]
    assert sum(made[i].kept == (i % 3 > 0) for i in held_out) / len(held_out) > 0.98
    assert all(0 <= r.score <= 1 for r in made.values())
    assert classifier.score(odd, model).count() == 8
    wide = df.select("*", F.lit("x").alias("meta"), F.lit(1).alias("y"), F.lit(2).alias("slot"))
    again = classifier.train(wide.repartition(7), labels.unionByName(labels))
    assert all(abs(a - b).max() < 1e-6 for a, b in zip(again.views, model.views, strict=True))
    empty = classifier.train(df.limit(0), labels)
    assert classifier.score(odd, empty).count() == 8 and classifier.score(df.limit(0), model).count() == 0
    nothing = classifier.train(df, labels.limit(0))
    assert classifier.score(df.limit(3), nothing).count() == 3


def test_sums_over_parts(spark):
    """What executors add up is what one pass over all rows gives, and views learn from each other."""
    import numpy as np

    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.5).astype(float)
    text, meta = np.zeros((3000, classifier.TEXT_WIDTH)), np.zeros((3000, classifier.META_WIDTH))
    text[:, 1], text[:, 20] = y + rng.normal(0, 0.35, 3000), rng.random(3000)
    meta[:, 0], meta[:, 9:40] = y + rng.normal(0, 0.4, 3000), rng.normal(0, 1, (3000, 31))
    text, meta = text.astype(np.float32).astype(float), meta.astype(np.float32).astype(float)
    rest = slice(200, None)
    whole = lambda model: classifier.taught(model, (text[rest], meta[rest]))
    packed = [(x.astype(np.float32).tobytes(), m.astype(np.float32).tobytes()) for x, m in zip(text[rest], meta[rest], strict=True)]
    spread = classifier._teach(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in packed], "text binary, meta binary").repartition(5))
    alone = classifier.fit((text[:200], meta[:200]), y[:200], whole, rounds=0)
    for (g, c, n), (g2, c2, n2) in zip(whole(alone), spread(alone), strict=True):
        assert n == n2 > 100 and np.allclose(g, g2) and np.allclose(c, c2)
    both = classifier.fit((text[:200], meta[:200]), y[:200], whole)

    def auc(z):
        order = z.argsort().argsort()
        good = y[rest] == 1
        return (order[good].mean() - order[~good].mean()) / len(z) + 0.5

    meta_before, meta_after = (auc(m.levels((text[rest], meta[rest]))[1]) for m in (alone, both))
    assert meta_after > meta_before + 0.005 and auc(both.scores((text[rest], meta[rest]))[2]) > 0.9


def test_clear_stages(spark):
    common.clear_stages(spark)
    made = common.stage(spark.range(3), "x")
    path = common._STAGED[-1]
    assert made.count() == 3
    common.clear_stages(spark)
    assert not common._STAGED
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_empty_tables(docs):
    none = docs.limit(0)
    levels = {"lang": "lang"}
    for made in (
        exact_dedup.exact_groups(none), minhash.near_groups(none), substring.remove_repeats(none), quality_rules.judge(none), packing.pack(none), token_counts.token_counts(none),
        licenses.scan(none.withColumn("path", F.col("source"))), classifier.score(none, classifier.train(none, none.select("doc_id", F.lit(1).alias("quality")))),
        mixing.mix(none, levels, {}), exact_dedup.drop_exact(none), minhash.drop_near(none), quality_rules.keep_good(none), mixing.take(none, levels, {}),
    ):
        assert made.count() == 0
