"""Operators against brute force, exact round trips, or held-out accuracy."""

import itertools
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from helpers import documents, prose, words
from plumbline.llm import decontaminate, langid, mixing, neardup, pii, quality, substring, tokens, warc


def planted(spark, n=60, seed=3):
    """Prose with near copies of rising distance, exact copies, and shared passages."""
    r = random.Random(seed)
    rows, passage = [], prose(999, 70)
    for i in range(n):
        text = prose(i, r.randrange(30, 300))
        if i % 6 == 1:
            text = rows[-1][1]
        elif i % 6 in (2, 3):
            w = rows[-1][1].split()
            for _ in range(max(1, len(w) * (i % 11) // 60)):
                w[r.randrange(len(w))] = f"z{r.randrange(999)}"
            text = " ".join(w)
        elif i % 6 == 4:
            w = text.split()
            w[10:10] = passage.split()[: 45 + i % 20]
            text = " ".join(w)
        rows.append((i, text, f"s{i % 3}", "en"))
    return documents(spark, rows), {i: words(t) for i, t, *_ in rows}


def test_near_duplicates_find_all_pairs(spark):
    docs, text = planted(spark)
    sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) for i, w in text.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(first[sets[i]], i): 1.0 for i in sets if first[sets[i]] != i}
    for a, b in itertools.combinations(sorted(first.values()), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= 0.5:
            want[a, b] = j
    got = {(r.doc_a, r.doc_b): r.jaccard for r in neardup.similar_pairs(docs).collect()}
    assert set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.95 * len(want) and len(want) > 20
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
    same = {(r.doc_a, r.doc_b) for r in neardup.similar_pairs(docs, broadcast_ids=0).collect()}
    assert same == set(got)


@pytest.mark.parametrize("m", [2, 40, 300])
def test_signature_tree_prunes_no_pair(m):
    r = np.random.default_rng(m)
    base = [set(r.integers(0, 10**9, 60).tolist()) for _ in range(6)]
    sets = [set(x for x in base[i % 6] if r.random() < 0.8) | set(r.integers(0, 10**9, r.integers(1, 30)).tolist()) for i in range(m)]
    bits = np.zeros((m, neardup.BITS), bool)
    for i, s in enumerate(sets):
        bits[i, [x % neardup.BITS for x in s]] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    tree = neardup.Tree(packed, np.array([len(s) for s in sets]))
    got = {(int(i), int(j)) for a, b in tree.pairs(0.5) for i, j in zip(a, b, strict=True)}
    need = {(i, j) for i, j in itertools.combinations(range(m), 2) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    assert need <= got
    assert m < 300 or len(got) < m * (m - 1) / 2 * 0.6


def test_groups_are_connected_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 4), (4, 30), (30, 31), (31, 32)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "doc_a long, doc_b long, jaccard double")
    from plumbline.llm.common import Scratch

    got = {r.doc_id: r["first"] for r in neardup.groups(df, Scratch(spark, "t")).collect()}
    assert got == {2: 1, 3: 1, 6: 5, 7: 5, 8: 5, 9: 5, 20: 4, 30: 4, 31: 4, 32: 4}


def spans_by_brute_force(text: dict) -> set:
    at = defaultdict(list)
    for i in sorted(text):
        for p in range(len(text[i]) - 49):
            at[tuple(text[i][p : p + 50])].append((i, p))
    hit = defaultdict(dict)
    for v in at.values():
        if len(v) > 1:
            for k, (i, p) in enumerate(v):
                hit[i][p] = k > 0
    out = set()
    for i, places in hit.items():
        for p in sorted(places):
            if out and cur[0] == i and p <= cur[2]:
                out.discard(tuple([*cur[:3], len(later)]))
            else:
                cur, later = [i, p, p], set()
            cur[2] = p + 50
            if places[p]:
                later |= set(range(p, p + 50))
            out.add(tuple([*cur[:3], len(later)]))
    return out


def test_substrings_are_those_of_brute_force(spark):
    docs, text = planted(spark)
    rows = substring.repeats(docs).collect()
    assert {(r.doc_id, r.start, r.end, r.later) for r in rows} == spans_by_brute_force(text)
    assert all(r.words == r.end - r.start >= 50 for r in rows) and all(50 <= r.longest <= r.words for r in rows)
    assert any(r.longest >= 100 for r in rows)
    assert {tuple(r) for r in substring.repeats(docs, hot=1).collect()} == {tuple(r) for r in rows}
    assert {tuple(r) for r in substring.repeats(docs, filter_anchors=0).collect()} == {tuple(r) for r in rows}


def test_substrings_repeated_within_a_text(spark):
    part = prose(5, 55)
    text = {1: f"{part} {prose(6, 40)} {part}", 2: "same " * 300, 3: prose(7, 200)}
    rows = substring.repeats(documents(spark, [(i, t, "s", "en") for i, t in text.items()])).collect()
    assert {(r.doc_id, r.start, r.end, r.later) for r in rows} == spans_by_brute_force({i: words(t) for i, t in text.items()})


def longest_by_brute_force(text: dict, spans) -> dict:
    out = {}
    for i, start, end in spans:
        length = 50
        while True:
            count = Counter(tuple(w[p : p + 2 * length]) for w in text.values() for p in range(len(w) - 2 * length + 1))
            if not any(count[tuple(text[i][p : p + 2 * length])] > 1 for p in range(start, end - 2 * length + 1)):
                break
            length *= 2
        out[i, start] = length
    return out


def test_longest_is_that_of_brute_force(spark):
    rows = []
    for k, n in enumerate([99, 100, 100, 100, 101, 105, 110, 120, 130, 199, 200, 200, 205, 220, 399, 400, 410]):
        shared = prose(500 + k, n)
        rows += [(2 * k + j, f"{prose(2000 + 2 * k + j, 20 + 7 * j)} {shared} {prose(4000 + 2 * k + j, 30)}", "s", "en") for j in (0, 1)]
    text = {i: words(t) for i, t, *_ in rows}
    for hot in (substring.HOT, 1):
        got = substring.repeats(documents(spark, rows), hot=hot).collect()
        assert {(r.doc_id, r.start): r.longest for r in got} == longest_by_brute_force(text, [(r.doc_id, r.start, r.end) for r in got])
        assert {r.longest for r in got} == {50, 100, 200, 400}


def test_windows_are_told_apart_by_64_bits(monkeypatch):
    import pyarrow as pa

    shared = prose(1, 30)  # the same anchor in different surroundings
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([f"{prose(i, 40)} {shared} {prose(i + 9, 40)}" for i in (2, 3)])], ["doc_id", "text"])
    whole = substring.span_hash
    monkeypatch.setattr(substring, "span_hash", lambda h, n: whole(h, n) & np.uint64(0xFFFFFFFF) if n == substring.LENGTH else whole(h, n))
    rows = pa.Table.from_batches(substring._anchors(lambda _, anchor, __: np.ones(len(anchor), bool))(iter([batch]))).sort_by("anchor").combine_chunks()
    assert len(set(rows.column("anchor").to_pylist())) < rows.num_rows
    assert not list(substring._repeated(iter(rows.to_batches())))


def shared_spans(a: list, b: list, least: int) -> set:
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, j, n))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40))
def test_winnowing_finds_every_long_span(seed, vocabulary):
    r = random.Random(seed)
    item = [f"v{r.randrange(vocabulary)}" for _ in range(r.randrange(5, 60))]
    doc = [f"v{r.randrange(vocabulary)}" for _ in range(r.randrange(5, 80))]
    cut = r.randrange(len(item))
    doc[5:5] = item[cut : cut + r.randrange(5, 40)]
    from plumbline.llm import textops as T
    import pyarrow as pa

    w = lambda x: T.words(*T.buffers(pa.array([" ".join(x)])))
    bench = decontaminate.Bench([1], w(item).hash, np.array([len(item)]), 4, 3)
    _, _, d, b, n = bench.hits(w(doc), 4, 3, 6)
    assert set(zip(d.tolist(), b.tolist(), n.tolist(), strict=True)) == shared_spans(doc, item, 6)


def test_decontamination_by_shuffle_is_the_same(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    two = {tuple(r) for r in decontaminate.contaminated(docs, bench, broadcast_words=0).collect()}
    assert one == two and one


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 200))
def test_budget_fit_is_optimal(classes, budget):
    size, count = zip(*classes, strict=True)
    best = max(s for take in itertools.product(*(range(c + 1) for c in count)) if (s := sum(t * z for t, z in zip(take, size, strict=True))) <= budget)
    take = mixing.fit(size, count, budget)
    assert (take <= np.array(count)).all() and (take >= 0).all()
    assert int((take * np.array(size)).sum()) == best


def test_waterfill_keeps_proportions():
    got = mixing.waterfill(np.array([10, 1000, 1000]), np.array([1.0, 1.0, 2.0]), 610)
    assert got.tolist() == [10, 200, 400]
    assert mixing.waterfill(np.array([5, 5]), np.array([0.0, 1.0]), 100).tolist() == [0, 5]


def test_mix_meets_its_budgets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = {f"src{i}": 1.0 + i % 3 for i in range(15)}
    rows = mixing.selected(mixing.lengths(docs), weights=weights, share=0.5).collect()
    total = Counter()
    for r in mixing.lengths(docs).collect():
        total[r.source] += r.n_tokens
    names = sorted(weights)
    want = dict(zip(names, mixing.waterfill(np.array([total[n] for n in names]), np.array([weights[n] for n in names]), 0.5 * sum(total[n] for n in names)), strict=True))
    got = Counter()
    for r in rows:
        got[r.source] += r.n_tokens
    assert set(got) <= set(names)
    assert all(0 <= want[n] - got[n] <= 0.02 * want[n] + 5 for n in names)
    assert len({r.doc_id for r in rows}) == len(rows)
    few = {r.doc_id for r in mixing.mixed(docs, weights=weights, share=0.5).collect()}
    many = {r.doc_id for r in mixing.mixed(docs, weights=weights, share=0.5, broadcast_cuts=0).collect()}
    assert few == many == {r.doc_id for r in rows}


def test_query_and_pipeline_mix_by_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    of = tokens.counter(tokens.VOCABULARY)
    n = {r.doc_id: of.text(r.text) for r in docs.select("doc_id", "text").collect()}
    rows = mixing.query(spark, sf).collect()
    assert rows and all(r.n_tokens == n[r.doc_id] for r in rows)
    last = corpus_pipeline.source_mixing(spark, docs, sf)
    assert "MapInArrow" not in last._jdf.queryExecution().toString()  # texts aren't counted again
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in rows}


def test_mixing_keeps_sources_of_one_text_apart(spark):
    text = prose(4, 20)
    docs = documents(spark, [(1, text, "a", "en"), (1, text, "b", "en"), (2, text, None, "en")])
    for limit in (10, 0):
        assert [r.source for r in mixing.mixed(docs, weights={"a": 1}, share=1.0, broadcast_cuts=limit).collect()] == ["a"]


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    def make(pieces, byte_fallback):
        t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        return t

    return make


def test_token_counts_are_the_tokenizers(spark, sf, reference_tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a", " a b ", "▁x y▁z", "日本語 привет \n\t é", "<s> hi <0x0A>", "a" * 3000, "☃☃☃ ☃", "x‍y"]
    pieces = tokens.vocabulary()
    t, mine = reference_tokenizer(pieces, True), tokens.Counter(pieces)
    assert [mine.text(x) for x in texts] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ▁☃é", max_size=30), st.booleans(), st.integers(0, 50))
def test_token_ties(reference_tokenizer, text, fallback, seed):
    r = random.Random(seed)
    pieces = [("<unk>", 0.0), ("▁", -3.0)] + [(p, float(-r.randrange(1, 5))) for p in ("a", "b", "ab", "bc", "abc", "▁a", "▁ab", "ca", "aa")]
    if seed % 2:
        pieces.append(("c", -2.0))
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    t = reference_tokenizer(pieces, fallback)
    assert tokens.Counter(pieces).text(text) == len(t.encode(text, add_special_tokens=False).ids)


def test_token_cache_changes_nothing(monkeypatch):
    pieces = tokens.vocabulary()
    text = prose(3, 2000)
    whole = tokens.Counter(pieces).text(text)
    monkeypatch.setattr(tokens, "CACHE_UNITS", 3)
    assert tokens.Counter(pieces).text(text) == whole


def test_warc_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write(pages, str(tmp_path / "a"), roll_bytes=9_000, shard_bytes=20_000)
    warc.write(pages.repartition(7), str(tmp_path / "b"), roll_bytes=9_000, shard_bytes=20_000)
    files = [f["file"] for f in json.loads((tmp_path / "a" / "MANIFEST.json").read_text())["files"]]
    assert len(files) > 4 and (tmp_path / "a" / "MANIFEST.json").read_text() == (tmp_path / "b" / "MANIFEST.json").read_text()
    back, uris = [], []
    for f in files:
        data = (tmp_path / "a" / f).read_bytes()
        assert data == (tmp_path / "b" / f).read_bytes()
        for head, payload in warc.read(data):
            assert warc.record(head["WARC-Target-URI"], head["WARC-Date"], payload)[1] == head["WARC-Payload-Digest"]
            back.append((head["WARC-Target-URI"], payload.decode()))
            uris.append(head["WARC-Target-URI"])
    assert sorted(back) == sorted((r.url, r.html) for r in pages.collect())
    assert len({h for f in files for h in [zlib.crc32((tmp_path / "a" / f).read_bytes())]}) == len(files)
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".tmp-")]
    for r in spark.read.parquet(str(tmp_path / "a" / "index")).limit(20).collect():
        one = (tmp_path / "a" / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert next(warc.read(one))[0]["WARC-Payload-Digest"] == r.digest
    keys = [r.key for r in spark.createDataFrame([(u,) for u in uris], "url string").select(warc._key(warc.F.col("url")).alias("key")).collect()]
    assert keys == sorted(keys)


PRIVATE = [
    ("jane dot doe (at) mail dot example dot com", "email"),
    ("jane.doe[at]example[dot]org", "email"),
    ("joe at gmail.com", "email"),
    ("jаne@exаmple.com", "email"),
    ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email"),
    ("x​y@a​b.com", "email"),
    ("five five five, one two three four five six seven", "phone"),
    ("+1 (017) 555-7713", "phone"),
    ("4111 1111 1111 1111", "card"),
    ("four one one one one one one one one one one one one one one one", "card"),
    ("10.250.3.1", "ip"),
    ("DE89370400440532013000", "iban"),
    ("123-45-6789", "ssn"),
]


@pytest.mark.parametrize(("value", "kind"), PRIVATE)
def test_identifiers_are_found_where_they_are(value, kind):
    for before, after in (("Write: ", " - thanks."), ("é☃ ", "\nBye"), ("", "")):
        text = before + value + after
        assert pii.find(text) == [(kind, len(before), len(before) + len(value))], text
        raw = np.frombuffer(text.encode(), np.uint8)
        assert pii.suspects(raw, np.array([0, len(raw)]))[0]
        assert pii.mask(text, pii.find(text)) == f"{before}[{kind.upper()}]{after}"


@pytest.mark.parametrize("zero", "۰०߀๐０𝟎")
@pytest.mark.parametrize(("value", "kind"), [("(017) 555-7713", "phone"), ("4111 1111 1111 1111", "card"), ("123-45-6789", "ssn")])
def test_digits_of_all_scripts_count(zero, value, kind):
    text = "x " + "".join(chr(ord(zero) + int(c)) if c.isdigit() else c for c in value) + " y"
    raw = np.frombuffer(text.encode(), np.uint8)
    assert pii.suspects(raw, np.array([0, len(raw)]))[0]
    assert pii.find(text) == [(kind, 2, len(text) - 2)]


def test_clean_texts_hold_no_identifiers():
    for text in ["At one point the dot was at two places.", "Room 12, page 345 of 9000", "version 1.2.3.4.5", "4111 1111 1111 1112", "a token of thanks: yes", "look at that. And go", prose(2, 300)]:
        assert pii.find(text) == [], text


def test_suspects_miss_nothing(spark, sf):
    import pyarrow as pa

    from plumbline.llm.textops import buffers

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    maybe = pii.suspects(*buffers(pa.array(texts)))
    assert all(m or not pii.find(t) for m, t in zip(maybe, texts, strict=True))
    assert 0 < maybe.sum() < 0.3 * len(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aа@.1 five(at)dо​é", max_size=60))
def test_offsets_stay_in_order(text):
    out, start, end = pii.normalise(text)
    assert len(out) == len(start) == len(end)
    assert (np.diff(start) >= 0).all() and (end > start).all() and (not len(end) or end[-1] <= len(text))


def test_quality_is_learnt(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter("doc_id % 3 <> 0"))
    rows = quality.scores(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1 and r.toxic == 0) for r in rows)
    assert right >= 0.9 * len(rows)
    clean = [r.score >= 0.5 for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(clean) >= 0.95 * len(clean)


def test_trees_keep_monotone_constraints():
    r = np.random.default_rng(1)
    x = r.random((600, 3))
    y = (np.sin(9 * x[:, 0]) + x[:, 1] + r.normal(0, 0.5, 600) > 0.6).astype(float)
    for sign in (1, -1):
        f = quality.grow(x, y, np.array([sign, 0, 0]), trees=25)
        grid = np.repeat(r.random((40, 3))[:, None], 30, 1)
        grid[:, :, 0] = np.linspace(0, 1, 30)
        s = f.score(grid.reshape(-1, 3)).reshape(40, 30)
        assert (np.diff(s, axis=1) * sign >= -1e-12).all()
    free = quality.grow(x, y, np.zeros(3), trees=25)
    assert ((free.score(x) > 0.5) == y).mean() > 0.75


def test_flat_trees_score_like_a_walk():
    r = np.random.default_rng(2)
    x, y = r.random((300, 4)), r.integers(0, 2, 300).astype(float)
    f = quality.grow(x, y, np.zeros(4), trees=7)

    def walk(row):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return total

    assert np.allclose(f.margin(x), [walk(row) for row in x])


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 300")
    held = docs.filter("doc_id % 2 = 0")
    content = langid.dictionaries(docs.filter("doc_id % 2 = 1"))
    rows = langid.identify(held, content).withColumnRenamed("lang", "got").join(held.select("doc_id", "lang"), "doc_id").collect()
    told = [r for r in rows if r.accepted]
    assert len(told) >= 0.9 * len(rows)
    assert sum(r.got == r.lang for r in told) >= 0.95 * len(told)


def test_very_long_texts_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text IS NOT NULL")
    of = langid.Classifier(langid.dictionaries(docs.filter("doc_id % 2 = 1")))
    text = defaultdict(list)
    for r in docs.filter("doc_id % 2 = 0").select("lang", "text").orderBy("doc_id").collect():
        text[r.lang].append(r.text)
    assert len(text) > 2
    for lang, parts in text.items():
        whole = " ".join(parts)[:1_000_000]
        assert len(whole) == 1_000_000
        short, long_ = of.classify(whole[:30_000]), of.classify(whole)
        assert short[0] == long_[0] == lang
        assert long_[1] > 0.5 * short[1]


def test_narrow_margins_are_rejected():
    c = langid.Classifier({"a": b"alpha beta gamma delta " * 40, "b": b"alpha beta gamma delta " * 40})
    assert c.classify("alpha beta gamma delta epsilon")[0] == "und"
    assert langid.Classifier({"a": b"alpha beta gamma delta " * 40, "b": b"one two three four five " * 40}).classify("alpha beta gamma delta alpha gamma")[0] == "a"
