import base64
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.llm.bpe import DEFAULT_VOCABULARY, PATTERN, TrieEncoder, encode_column, slices
from graphloom.llm.packing import pack
from graphloom.llm.spans import Block, SharedSpans, anchors
from graphloom.llm.terms import BurstTrie, route_of, term_counts, terms_of

D = "doc_id long, text string, tokens int, cls string"  # the last two clash with inner names


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], D)


@pytest.fixture(scope="module")
def encoder():
    return TrieEncoder()


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY.replace(".json", ".tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, texts):
    flat, at = encoder.encode_texts(texts)
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60))
def test_encoding_is_exact(encoder, reference, text):
    assert ids(encoder, [text]) == [reference.encode_ordinary(text)]


def test_encoding_of_odd_texts(encoder, reference):
    rnd = random.Random(3)
    odd = [" ", "\r\n \t", "\x1c\x85 a", "<|endoftext|>", "a" * 3000, "=" * 500, " " * 700 + "x", "naïve café", "🚀🚧", "é"]
    odd += ["".join(rnd.choice("abcdeABC ") for _ in range(rnd.randint(1, 50))) for _ in range(500)]
    assert ids(encoder, odd) == [reference.encode_ordinary(t) for t in odd]
    assert ids(encoder, [None, "", "a"])[:2] == [[], []]


def test_every_token_is_its_own_encoding(encoder):
    words = sorted(b for b in encoder.ids)
    assert [t for t, in encoder.encode_words(words)] == [encoder.ids[b] for b in words]


def test_encode_column(spark, reference):
    texts = ["Hello world", None, "", "Hello world", "x " * 5000]
    got = {r["doc_id"]: r["ids"] for r in encode_column(docs(spark, texts)).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode_column(docs(spark, ["a"]).limit(0)).count() == 0


def test_slices_cover_all():
    assert [*slices([5, 5, 20, 0, 1], 10)] == [(0, 2), (2, 3), (3, 5)] and [*slices([])] == []


def test_packing_keeps_every_token(spark, encoder):
    rnd = random.Random(1)
    texts = [None, "", "same text here"] + ["same text here"] * 3 + [" ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(rnd.randint(1, 300))) for _ in range(150)]
    texts += ["word " * 1000, "word " * 256, "w" * 9000]
    rows = pack(docs(spark, texts), capacity=256, shard_tokens=6000).collect()
    size = dict(enumerate(len(x) for x in ids(encoder, texts)))
    held, spans = {}, {}
    for r in rows:
        held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
        spans.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
    assert max(held.values()) <= 256
    for d, n in size.items():
        at = 0
        for s, k in sorted(spans.get(d, [])):
            assert s == at
            at += k
        assert at == n and (n > 256 or len(spans.get(d, [])) == (n > 0))
    boxes = []  # first fit decreasing over all items at once, which knows no shards and no relevance
    for n in sorted((k for d in spans for _, k in spans[d]), reverse=True):
        at = next((i for i, used in enumerate(boxes) if used + n <= 256), None)
        boxes.append(n) if at is None else boxes.__setitem__(at, boxes[at] + n)
    assert len(held) <= 1.04 * len(boxes) + 5  # a last container for each of five shards
    assert len({(r["container_id"], r["position"]) for r in rows}) == len(rows)
    assert pack(docs(spark, [None, ""])).count() == 0


def test_packing_brings_like_documents_together(spark):
    rnd = random.Random(2)
    vocab = [[f"{g}{i}" for i in range(30)] for g in ("river", "engine", "violin", "tax")]
    texts = [" ".join(rnd.choice(vocab[k % 4]) for _ in range(40)) for k in range(160)]
    rows = pack(docs(spark, texts), capacity=512).collect()
    by = {}
    for r in rows:
        by.setdefault(r["container_id"], []).append(r["doc_id"] % 4)
    pure = sum(max(map(v.count, set(v))) for v in by.values()) / len(rows)
    assert pure > 0.8  # chance would be about 0.45


def test_terms():
    assert terms_of("Café CAFÉ x_y ½ 3²​٣") == ["café", "café", "x", "y", "½", "3²", "٣"]
    assert terms_of(None) == terms_of(" \n") == []
    import sys
    import unicodedata

    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.category(c) != "Cs":
            assert bool(terms_of("a" + c) == ["a" + unicodedata.normalize("NFC", "a" + c).lower()[1:]] and c.lower() == c and len(terms_of(c)) == 1) or not (
                unicodedata.category(c)[0] in "LN" and c.lower() == c and unicodedata.normalize("NFC", c) == c
            )


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=5)))
def test_burst_trie_counts(words):
    t = BurstTrie(burst=3)
    for w in words:
        t.add(w, 2, 1)
    got = {}
    for prefix, rests, occ, rec in t.leaves():
        for w, o, r in zip(rests, occ, rec):
            assert prefix + w not in got
            got[prefix + w] = (o, r)
    assert got == {w: (2 * words.count(w), words.count(w)) for w in words} and t.terms == len(got)
    for p, n in t.weights(0).items():
        assert n == sum(w.startswith(p) for w in got)
    assert set(t.weights(0)) == {w[:i] for w in got for i in range(len(w) + 1)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", max_size=6), max_size=12), max_size=4), st.sets(st.text(alphabet="ab", max_size=3)))
def test_routed_subtrees_merge_to_the_sum(parts, some):
    """Tries burst differently; cut at any set of split prefixes and merged by route they give the counts."""
    split = frozenset(p[:i] for p in some for i in range(len(p) + 1))
    tries = {}
    for k, words in enumerate(parts):
        t = BurstTrie(burst=1 + k)
        for w in words:
            t.add(w, 1, 1)
        for prefix, rests, occ, rec in t.leaves():
            for r, o, c in zip(rests, occ, rec):
                route = route_of(prefix + r, split)
                assert (prefix + r).startswith(route) and (prefix in split or route == route_of(prefix, split))
                tries.setdefault(route, BurstTrie(burst=2)).graft(prefix, [r], [o], [c])
    got = {}
    for t in tries.values():
        for prefix, rests, occ, rec in t.leaves():
            for r, o in zip(rests, occ):
                assert prefix + r not in got
                got[prefix + r] = o
    assert got == Counter(w for words in parts for w in words)


def test_term_counts(spark):
    texts = ["a a b"] * 12 + ["b Ç", "ç ç", None, "", " . ", "x" * 100_000]
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in term_counts(docs(spark, texts), trie_terms=1).collect()}
    assert got == {"a": (24, 12, "common"), "b": (13, 13, "common"), "ç": (3, 2, "rare"), "x" * 100_000: (1, 1, "rare")}
    assert term_counts(docs(spark, ["a"]).limit(0)).count() == 0


def test_a_prefix_that_most_terms_share_is_split(spark):
    long = "p" * 40  # longer than prefixes can be split
    terms = [f"pre{i:04d}" for i in range(3000)] + [f"{long}{i}" for i in range(2000)] + [f"q{i}" for i in range(50)]
    rnd = random.Random(7)
    texts = [" ".join(rnd.sample(terms, 400)) for _ in range(60)]
    want, recs = Counter(), Counter()
    for t in texts:
        want.update(t.split())
        recs.update(set(t.split()))
    df = docs(spark, texts).repartition(4)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(df, routes=16, least_route=20).collect()}
    assert got == {t: (want[t], recs[t]) for t in want}
    split = frozenset(["", *[long[:i] for i in range(1, 33)]])
    assert len({route_of(t, split) for t in terms if t.startswith(long)}) > 32 and route_of("q1", split) == "q"


def shared(a, b, n):
    return any(a[i : i + n] in b for i in range(len(a) - n + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_spans_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("ab é🚀") for _ in range(n))
    base = [text(rnd.randint(0, 160)) for _ in range(30)]
    for k in range(25):
        s = text(rnd.choice([18, 19, 20, 21, 40]))
        for i in rnd.sample(range(30), rnd.choice([2, 2, 3])):
            at = rnd.randint(0, len(base[i]))
            base[i] = base[i][:at] + s + base[i][at:]
    mid, side = text(22), [text(30) for _ in range(6)]
    # One text holds a span in two surroundings, others in one of them each.
    base += [side[0] + mid + side[1] + side[2] + mid + side[3], side[4] + side[0] + mid + side[1], side[2] + mid + side[3] + side[5]]
    base += [base[0], base[0], "=" * 100, "x" + "=" * 50, None, "", "=" * 19]
    s = SharedSpans(docs(spark, base), span=20)
    want = {(i, j) for j in range(len(base)) for i in range(j) if base[i] and base[j] and shared(base[i], base[j], 20)}
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in s.document_pairs().collect()} == want
    for r in s.report(docs(spark, base)).collect():
        t = base[r["doc_id"]] or ""
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - 19):
            if any(k != r["doc_id"] and o and t[i : i + 20] in o for k, o in enumerate(base)):
                mark[i : i + 20] = True
        assert (r["chars"], r["shared_chars"]) == (len(t), mark.sum())


def test_equal_spans_hold_a_common_anchor():
    rnd = random.Random(4)
    for _ in range(30):
        span = "".join(rnd.choice("abcd") for _ in range(200))
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 300))) for _ in range(2))
        mine, h = anchors([a + span + b, b + span + a], 200)
        assert set(h[mine == 0]) & set(h[mine == 1])


def test_block_parse_finds_factors_across_boundaries():
    b = Block("0123456789" * 3 + "abcdefghijklmnopqrstuvwxyz", 10)
    assert b.factors("zz0123456789abcdefghijkl__") == [(2, 20, 22)]
    assert Block("ABCDEFGHIJ--FGHIJKLMNOP", 10).factors("ABCDEFGHIJKLMNOP") == [(0, 0, 10), (5, 12, 11)]
    assert b.factors("short") == []


def test_factors_are_the_longest_matches():
    a, b = "abcdefghij", "0123456789"
    block = Block("x" + a + "--" + a + b + "==" + a + b[:5] + "z", 10)
    assert block.factors("?" + a + b + "!") == [(1, 13, 20)]
    assert block.factors(a + b[:5] + "z")[0] == (0, 35, 16)
    same = Block("=" * 3000, 10)
    assert same.factors("=" * 700) == [(0, 0, 700)] and same.factors("=" * 5000)[0] == (0, 0, 3000)
    rnd = random.Random(9)
    for _ in range(40):
        x, y = ("".join(rnd.choice("ab") for _ in range(120)) for _ in range(2))
        for i, j, m in Block(x, 6).factors(y):
            most = max(next((k for k in range(121) if i + k >= len(y) or t + k >= len(x) or y[i + k] != x[t + k]), 0) for t in range(len(x)))
            assert m == most and y[i : i + m] == x[j : j + m]


def test_unequal_texts_with_one_hash(spark):
    from pyspark.sql import functions as F

    base = ["a" * 25 + "bcd", "a" * 25 + "xyz", "a" * 25 + "bcd", "q" * 12 + "w" * 16, "q" * 28]
    poor = lambda seed: F.when(F.lit(seed) < 3, F.length("text").cast("long")).otherwise(F.xxhash64(F.lit(seed), "text"))
    s = SharedSpans(docs(spark, base), span=20, code=poor)
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in s.document_pairs().collect()} == {(0, 1), (0, 2), (1, 2)}
    assert s.members.select("cls").distinct().count() == 4


def test_a_passage_of_many_texts_costs_one_parse_each(spark):
    rnd = random.Random(11)
    head = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    n = 1500
    texts = [head + "".join(rnd.choice("ijklmnop ") for _ in range(60)) for _ in range(n)]
    s = SharedSpans(docs(spark, texts), span=40)
    links = s.factors.select("cls", "other").distinct().count()
    assert n - 1 <= links <= 6 * n  # where the texts part, chance makes small windows of their own
    rows = s.report(docs(spark, texts)).where("shared_chars >= 120").count()
    assert rows == n
    assert s.class_pairs().count() == n * (n - 1) // 2


def test_spans_on_empty_table(spark):
    s = SharedSpans(docs(spark, ["x"]).limit(0))
    assert s.document_pairs().count() == 0 and s.report(docs(spark, [None, "x"])).count() == 2
