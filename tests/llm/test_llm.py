"""The training-data operators against brute force, and their defined results for odd tables."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import chat, exact, fingerprints, mixing, near, packing, substrings, tokens, toxicity, urls
from sievework.llm import queries as registered

SMALL = "/root/testdata/sf0.001"
SPACES = re.compile(r"[\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and white-space texts, repeated rows, a shared identifier, odd white space, wide characters, one very long text and one very long word.
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta"), (1, "Alpha beta gamma delta epsilon zeta eta theta"), (2, "ALPHA beta gamma delta epsilon zeta eta theta"), (3, None), (4, ""), (5, " \t\n "), (None, "null id text here"), (None, None),
    (7, "one"), (7, "two"), (8, "Ünï\u00a0cödé\u2003text 日本語 🙂 é"), (9, "word " * 40_000), (10, "x" * 300_000), (11, "a\x0bb\x0cc\rd\x1ce"), (12, "<|endoftext|> and <|ENDOFTEXT|>"), (13, "don't can't.. 12,5 a.b., x'."),
]


def docs_of(spark, rows, partitions: int = 3):  # noqa: ANN001, ANN201
    """Rows (doc_id, text) as documents with further columns, one of them with a name that operators use themselves."""
    full = [(i, t, "en", f"s{k % 3}" if k % 5 else None, 0) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOC).repartition(partitions).withColumns({"size": F.lit("x"), "n": F.lit("y"), "key": F.lit(1), "place": F.lit(2), "token": F.lit(3)})


@pytest.fixture(scope="module")
def odd(spark):  # noqa: ANN001, ANN201
    return docs_of(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def small() -> list[tuple[int, str]]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()


def words(text: str | None) -> list[str]:
    return [w for w in SPACES.split(text or "") if w]


def low(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1 token counts


def greedy(vocabulary: set[bytes], word: bytes) -> int:
    n, longest, word = 0, max(map(len, vocabulary)), b" " + word
    while word:
        k = min(longest, len(word))
        while word[:k] not in vocabulary:
            k -= 1
        word, n = word[k:], n + 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=2, max_size=5).filter(lambda b: not set(b) & set(b"\t\n\v\f\r ")), max_size=25), st.lists(st.text("abcde é", min_size=1, max_size=150).map(lambda s: s.replace(" ", "") or "a"), min_size=1, max_size=8))
def test_the_automaton_counts_greedy_matches(vocabulary, texts):  # noqa: ANN001
    extra = {t[:k] for x in texts for t in (x.encode(), b" " + x.encode()) for k in (2, 3, 5)}
    vocabulary = vocabulary | extra
    data = [x.encode() for x in texts]
    got = tokens.Automaton(vocabulary).count(pa.array(data, pa.binary())).tolist()
    assert got == [greedy(vocabulary | {bytes([c]) for c in range(256)}, w) for w in data]


def test_token_counts_of_documents(spark, small, odd, empty):  # noqa: ANN001
    vocabulary = set(tokens.read_ranks(registered.BYTE_RANKS))
    rows = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in registered.op1_token_counts(spark, SMALL).collect()}
    assert rows == {i: (len(words(t)), sum(greedy(vocabulary, w.encode()) for w in words(t))) for i, t in small}
    held = Counter(map(tuple, tokens.token_counts(odd, registered.BYTE_RANKS).collect()))
    assert held == Counter((i, len(words(t)), sum(greedy(vocabulary, w.encode()) for w in words(t))) for i, t in ODD if i != 10) + Counter(r for r in held if r[0] == 10)
    assert tokens.token_counts(empty, registered.BYTE_RANKS).count() == 0


# 2 URL filters


def test_cascades_are_exact(spark):  # noqa: ANN001
    keys = [f"h{k}.example" for k in range(5000)]
    listed = spark.createDataFrame([(k,) for k in keys[::7]] + [("elsewhere",)], "key string")
    frame = spark.createDataFrame([(k,) for k in keys * 2] + [(None,), ("",)], "key string")
    for shard in (100_000, 300):  # one shard, and several with a broadcast a few
        made = urls.cascades(frame, listed, shard).cache()
        marked = urls.with_listed(frame, made, "key", at_once=1 << 20 if shard > 300 else 400)
        assert {r["key"] for r in marked.where("listed").collect()} == set(keys[::7])
        assert marked.count() == 10_002


def test_urls_are_parsed_and_judged(spark):  # noqa: ANN001
    rows = [
        (1, "http://A.NET/x", "a.net", "/x", "net/", "block"), (2, "https://www.example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"), (3, "//x.net/", "", "", None, "allow"), (4, None, "", "", None, "allow"),
        (5, "x://b.org/fr/?", "b.org", "/fr/", "org/fr/", "allow"), (6, "x://borg/fr/", "borg", "/fr/", None, "allow"), (7, "x://net", "net", "", None, "allow"), (8, "x://net/", "net", "/", "net/", "block"), (9, "x://adult-x.example.com/de/1", "adult-x.example.com", "/de/1", "example.com/de/", "block"),
        (10, "x://ADULT-X.example.com?a", "adult-x.example.com", "", None, "block"), (11, "", "", "", None, "allow"), (12, "a://b://c", "b:", "//c", None, "allow"), (None, "x://myexample.net/en/", "myexample.net", "/en/", "net/", "block"), (12, "a://b://c", "b:", "//c", None, "allow"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumns({"host": F.lit("z"), "listed": F.lit(0)})
    got = urls.judge_urls(pages, urls.listed_hosts(spark)).select("page_id", "host", "path", "rule", "verdict")
    assert Counter(map(tuple, got.collect())) == Counter((r[0], *r[2:]) for r in rows)
    assert urls.judge_urls(pages.limit(0), urls.listed_hosts(spark)).count() == 0


# 3 packing


def check_packed(rows, texts, capacity: int = packing.CAPACITY) -> None:  # noqa: ANN001
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registered.WORD_BPE)
    want = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)) for s in range(0, len(ids), capacity))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    held: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_is_an_exact_cover(spark, small, odd, empty):  # noqa: ANN001
    check_packed(registered.op3_packing(spark, SMALL).collect(), small)
    check_packed(packing.pack(odd, registered.WORD_BPE).collect(), ODD)
    assert packing.pack(empty, registered.WORD_BPE).count() == 0


MARKS = "\u0300\u0301\u0303\u0308\u030a\u030c\u0323\u0331\u0345\u0338"
ODD_LETTERS = "HTJWYAaeßİıΣςKÅﬁ日本🙂´`'’\u0085\u00a0\u2028\u200b\x1c.,;:!-_<|>09٣²"


def test_ids_are_those_of_whole_texts():  # noqa: ANN201
    from tokenizers import Tokenizer

    random.seed(5)
    alphabet = [*"abcdeHTJWY", *MARKS * 2, *ODD_LETTERS, *" \t\n  ", "<|endoftext|>", "don't", " The", "It's"]
    texts = ["".join(random.choices(alphabet, k=random.randrange(1, 25))) for _ in range(100_000)]
    texts += ["H\u0331ello", "T\u0308 J\u030c W\u030a Y\u030a a\u0331.", "\u0331", ""]
    definition = Path(registered.WORD_BPE).read_text()
    ids, counts = packing.Ids(definition).of(pa.array(texts))
    wanted = [e.ids for e in Tokenizer.from_str(definition).encode_batch_fast(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [x for w in wanted for x in w]


def test_ids_are_made_in_one_thread():  # noqa: ANN201
    code = "import os, sys, pyarrow as pa; from pathlib import Path; from sievework.llm import packing; pa.set_cpu_count(1); "
    code += "maker = packing.Ids(Path(sys.argv[1]).read_text()); n = len(os.listdir('/proc/self/task')); "
    code += "maker.of(pa.array([' '.join(f'w{k}' for k in range(9000))])); print(len(os.listdir('/proc/self/task')) - n)"
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    assert subprocess.run([sys.executable, "-c", code, registered.WORD_BPE], env=env, cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout == "0\n"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_use_all_lengths_and_fill_best(counts):  # noqa: ANN001
    left = Counter(counts)
    for times, chosen in packing.plan(counts, 64):
        total = sum(n * c for n, c in chosen)
        assert total <= 64 and times > 0
        reach = {chosen[0][0]}
        for n, c in (left - Counter({chosen[0][0]: 1})).items():
            for _ in range(min(c, 64 // n)):
                reach |= {r + n for r in reach if r + n <= 64}
        assert total == max(reach)
        left.subtract({n: c * times for n, c in chosen})
    assert not +left and not -left


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), min_size=1, max_size=400, unique=True))
def test_the_store_finds_what_it_was_given(keys):  # noqa: ANN001
    a, b = (np.array([k[n] for k in keys], np.uint64) for n in (0, 1))
    store, half = packing.Store(1000), len(keys) // 2
    store.add(a[:half], b[:half], np.arange(half))
    assert store.find(a, b).tolist() == [*range(half), *[-1] * (len(keys) - half)]
    store.add(a[half:], b[half:], np.arange(half, len(keys)))
    assert store.find(a, b).tolist() == list(range(len(keys)))


# 4 exact deduplication


def brute_exact(rows, largest=True):  # noqa: ANN001, ANN201
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        for n, i in enumerate(sorted(ids, key=lambda i: i != keep)):
            out[i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("size", [32, 1])
def test_exact_groups(spark, odd, empty, size):  # noqa: ANN001
    weak = lambda data: hashlib.sha256(data).digest()[:size]
    for keep in ("largest", "smallest"):
        assert Counter(map(tuple, exact.exact_groups(odd, keep, digest=weak).collect())) == brute_exact(ODD, keep == "largest")
    assert exact.exact_groups(empty).count() == 0


def test_one_row_of_each_text_stays(spark, odd):  # noqa: ANN001
    kept = exact.without_copies(odd, "largest")
    assert kept.columns == odd.columns
    assert Counter(low(r["text"]) for r in kept.collect()) == Counter({low(t) for _, t in ODD})
    want = {t: i for (i, i2, _, k, t) in brute_exact(ODD) if k}
    assert all(want[hashlib.sha256(low(r["text"]).encode()).hexdigest()] == r["doc_id"] for r in kept.collect())


def test_the_index_compacts_and_looks_up():  # noqa: ANN201
    random.seed(1)
    index, want = exact.Index(memtable=16), {}
    for place in range(3000):
        d, i = hashlib.sha256(str(random.randrange(700)).encode()).digest(), random.randrange(10**6)
        index.put(d, i, place)
        best, n = want.get(d, ((i, place), 0))
        want[d] = (min(best, (i, place)), n + 1)
    assert len(index.levels) > 2
    assert all(index.get(d) == (d, *best, n) for d, (best, n) in want.items()) and index.get(b"\0" * 32) is None
    assert list(index.entries()) == [(d, *best, n) for d, (best, n) in sorted(want.items())]


# 5 chat formatting


TURN = "conv_id long, turn long, role string, text string"


def test_preferences(spark):  # noqa: ANN001
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|x"), (1, 2, "user", "and"), (2, 0, "user", "q"), (3, 0, None, None), (None, 0, "user", "n")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "q"), (4, 0, "assistant", "only"), (None, 0, "user", "n")]
    df = lambda rows: spark.createDataFrame(rows, TURN).withColumns({"turns": F.lit(1), "other": F.lit(2)})
    rows = {r["conv_id"]: r for r in chat.format_preferences(df(a), df(b)).collect()}
    one = rows[1]
    assert (one["n_prompt_turns"], one["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    assert one["chosen"] == "<|assistant|>\n<\u200b|x<|end|>\n<|user|>\nand<|end|>\n" and one["rejected"] == "<|assistant|>\nyo<|end|>\n"
    start, end = map(int, one["chosen_mask"].split("-"))
    assert one["chosen"][start:end] == "<\u200b|x<|end|>"
    assert (rows[2]["prompt"], rows[2]["chosen"], rows[2]["rejected_mask"]) == ("<|user|>\nq<|end|>\n", "", "")
    assert (rows[3]["n_prompt_turns"], rows[3]["chosen"], rows[3]["rejected"]) == (0, "<||>\n<|end|>\n", "")
    assert (rows[4]["chosen"], rows[4]["rejected_mask"]) == ("", "14-25") and rows[None]["n_prompt_turns"] == 1


def test_swapped_answers(spark):  # noqa: ANN001
    rows = [(c, k, r, t) for c in range(12) for k, r, t in ((0, "user", f"u{c}"), (1, "assistant", f"a{c % 5}"), (2, "user", "bye"))] + [(99, 0, "user", "no answer"), (5, 1, "assistant", "a0")]
    frame = spark.createDataFrame(rows, TURN).repartition(3)
    for group in (chat.GROUP, 2):
        pairs = chat.format_pairs(chat.with_swapped_answers(frame, group=group)).collect()
        assert len(pairs) == 13 and all(p["prompt"].startswith("<|user|>\n") for p in pairs)
        for p in pairs:
            assert (p["chosen"] == p["rejected"]) == (p["chosen"] == "")
    assert chat.preference_rows(frame.limit(0)).count() == 0


# 6 fingerprints


def brute_sketch(text, scale=fingerprints.SCALE, few=fingerprints.FEW):  # noqa: ANN001, ANN201
    import xxhash

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def of(values) -> int:  # noqa: ANN001
        seed = 42
        for v in values:
            if v is not None:
                seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return signed(seed)

    held = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(low(text))]
    runs = [held[k : k + 5] for k in range(max(1, len(held) - 4))] if held else []
    every = sorted({of([*r, *[None] * (5 - len(r))]) for r in runs})
    kept = [h for h in every if h < -(1 << 63) + (1 << 64) // scale]
    if len(kept) >= few:
        return kept, -(1 << 63) + (1 << 64) // scale - 1
    return every[:few], (1 << 63) - 1 if len(every) <= few else every[few - 1]


def brute_likeness(a, b) -> float:  # noqa: ANN001
    upto = min(a[1], b[1])
    x, y = ({h for h in s[0] if h <= upto} for s in (a, b))
    return 1.0 if not a[0] and not b[0] else len(x & y) / len(x | y) if x | y else 0.0


def check_fingerprints(rows, texts) -> None:  # noqa: ANN001
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(after)
        text = lambda s: f"{s[1] & (1 << 64) - 1:016X}:" + "".join(f"{h & (1 << 64) - 1:016X}" for h in s[0])
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows)
    assert got == want


def test_fingerprints(spark, small, odd, empty):  # noqa: ANN001
    check_fingerprints(registered.op6_fingerprints(spark, SMALL).collect(), small)
    check_fingerprints(fingerprints.fingerprints(odd).collect(), ODD)
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(odd.where("doc_id = 2")).first()
    assert one["near_next"] == 1.0


def test_sketches_merge_and_contain(spark):  # noqa: ANN001
    text = [" ".join(f"w{k}" for k in range(n, m)) for n, m in ((0, 3000), (1000, 2000), (2500, 6000))]
    rows = spark.createDataFrame([tuple(text)], "a string, b string, c string").select(*[fingerprints.sketch(F.col(x)).alias(x) for x in "abc"])
    got = rows.select(fingerprints.containment(F.col("b"), F.col("a")), fingerprints.merged(F.col("a"), F.col("c"))["hashes"], fingerprints.sketch(F.lit(" ".join(f"w{k}" for k in range(6000))))["hashes"]).first()
    assert got[0] == 1.0
    assert got[1] == got[2]


# 7 near-duplicates


def brute_components(rows, share=near.SHARE):  # noqa: ANN001, ANN201
    sets = {}
    for i, t in rows:
        w = words(low(t))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    above = {i: i for i in sets}

    def root(i):  # noqa: ANN001, ANN202
        while above[i] != i:
            i = above[i]
        return i

    having: dict = {}
    for i in sorted(sets):
        meets = Counter(j for g in sets[i] for j in having.get(g, ()))
        for j, n in meets.items():
            if 100 * n >= share * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                above[b] = a
        for g in sets[i]:
            having.setdefault(g, []).append(i)
    return {i: (i, len(sets[i]), root(i), root(i) == i) for i in sets}


def planted(seed: int) -> list[tuple[int, str | None]]:
    """A large group of near copies, a chain of edits, texts that share a passage, short texts and copies."""
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    base, out = [random.choice(vocabulary) for _ in range(120)], []
    for _ in range(120):
        w = list(base)
        for _ in range(random.randint(0, 6)):
            w[random.randrange(120)] = random.choice(vocabulary)
        out.append(" ".join(w))
    w = list(base)
    for _ in range(40):
        for _ in range(3):
            w[random.randrange(120)] = random.choice(vocabulary)
        out.append(" ".join(w).upper())
    passage = random.sample(vocabulary, 60)
    for _ in range(80):
        w = [random.choice(vocabulary) for _ in range(40)]
        out.append("  ".join(w[:15] + passage + w[15:]))
    out += ["", None, "a b", "A  b", "a b c", "a b c d e f g h i", "a b c d e f g h i j", " ", "one"] * 2
    random.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_brute_force(spark, seed):  # noqa: ANN001
    rows = planted(seed)
    got = near.near_components(docs_of(spark, rows, 5)).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == brute_components(rows) and len(got) == len(rows)


def test_near_queries_and_odd_tables(spark, small, odd, empty):  # noqa: ANN001
    assert {r["doc_id"]: tuple(r) for r in registered.op7_near_dedup(spark, SMALL).collect()} == brute_components(small)
    rows = near.near_components(odd).collect()
    assert len(rows) == len(ODD) and {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert near.near_components(empty).count() == 0
    kept = near.without_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i, _ in ODD if i not in (2, None))


def test_long_lists_are_dealt_to_blocks(spark, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(near, "BLOCK", 8)
    rows = planted(3)
    got = near.near_components(docs_of(spark, rows, 5)).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == brute_components(rows) and len(got) == len(rows)


def test_a_large_group_that_is_just_too_different_makes_few_pairs(spark, monkeypatch):  # noqa: ANN001
    random.seed(8)
    template = [f"t{k}" for k in range(60)]
    rows = []
    for i in range(2500):  # three words of three shingles each differ: 49 of 67 shingles are shared
        w = list(template)
        for at in (10, 30, 50):
            w[at] = f"x{random.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    rows += [(2500 + i, t.replace("t5 ", "z ") if i % 2 else t + " end") for i, (_, t) in enumerate(rows[:40])]
    seen = []
    plain = near.confirmed
    monkeypatch.setattr(near, "confirmed", lambda pairs, *more: seen.append(pairs.count()) or plain(pairs, *more))
    got = {r["doc_id"]: r["component_id"] for r in near.near_components(docs_of(spark, rows)).collect()}
    assert got == {i: i if i < 2500 else i - 2500 for i, _ in rows}
    assert sum(seen) < 8 * len(rows)


def test_the_pipeline_removes_copies_by_either_rule(spark):  # noqa: ANN001
    pipeline = pytest.importorskip("corpus_pipeline")
    random.seed(3)
    fresh = lambda n: [f"v{random.randrange(10**9)}" for _ in range(n)]
    base, other = fresh(200), fresh(200)
    block = base[:90] + fresh(17) + base[107:]  # five words 0.81, three words 0.83
    scattered = [w if k % 40 != 20 else "x" for k, w in enumerate(other)]  # five words 0.77, three words 0.86
    joint = block[:10] + fresh(17) + block[27:]  # a copy of the second document only
    far = base[:90] + fresh(30) + base[120:]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, block, other, scattered, joint, far])]
    kept = lambda *rules: sorted(r["doc_id"] for r in near.without_near_copies(docs_of(spark, rows), *rules).collect())
    assert kept() == [0, 1, 2, 4, 5] and kept(80, 5) == [0, 2, 3, 5]
    assert sorted(r["doc_id"] for r in pipeline.remove_near_copies(spark, docs_of(spark, rows), SMALL).collect()) == [0, 2, 5]
    assert near.matches(80) < near.matches(85) == near.matches(95)
    with pytest.raises(ValueError, match="matches"):
        near.near_components(docs_of(spark, rows), share=79)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_stars_find_components(spark, links):  # noqa: ANN001
    few = near.FEW_EDGES
    above = list(range(26))
    for _ in range(26):
        for a, b in links:
            above[a] = above[b] = min(above[a], above[b])
    try:
        for near.FEW_EDGES in (few, 0):
            got = {r["node"]: r["comp"] for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
            assert all(got.get(n, n) == above[n] for pair in links for n in pair)
    finally:
        near.FEW_EDGES = few


# 8 mixing


def brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in full} if full else {s: level * weight[s] for s in free}
        left -= sum(3 * sizes[s] for s in full)
        free = free - full if full else set()
    return target


def check_mixed(rows, texts) -> None:  # noqa: ANN001
    sizes = Counter()
    for s, t in texts:
        sizes[s] += len(words(t))
    want, taken, longest = brute_targets(sizes), Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in {n * r["size"] for n in range(4)}
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= longest[s] + 1e-6 for s in sizes)


def test_mixing(spark, odd, empty):  # noqa: ANN001
    held = duckdb.sql(f"SELECT source, text FROM '{SMALL}/documents.parquet'").fetchall()
    rows = registered.op8_mixing(spark, SMALL).collect()
    check_mixed(rows, held)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, registered.op8_mixing(spark, SMALL).collect()))
    check_mixed(mixing.mix(odd).collect(), [(r["source"], r["text"]) for r in odd.collect()])
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd.where("text IS NULL")).agg(F.sum("taken")).first()[0] == 0


def test_a_mix_of_rows_repeats_them(spark, odd):  # noqa: ANN001
    times = Counter()
    for r in mixing.mix(odd).where("taken > 0").collect():
        times[r["doc_id"], r["size"]] += r["taken"] // r["size"]
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in mixed.collect()) == times


# 9 repeated passages


def brute_removal(rows, size=substrings.WINDOW):  # noqa: ANN001, ANN201
    split = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[k : k + size]) for _, w in split for k in range(len(w) - size + 1))
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if counts[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def repeats(seed: int) -> list[tuple[int | None, str | None]]:
    random.seed(seed)
    vocabulary = [f"v{k}" for k in range(300)]
    passages = [[random.choice(vocabulary) for _ in range(n)] for n in (34, 35, 36, 70, 50)]
    out = []
    for k in range(150):
        w = [random.choice(vocabulary) for _ in range(random.randint(0, 60))]
        for _ in range(random.randint(0, 3)):
            w += random.choice(passages)
        out.append((random.choice([k, None, 5]), "  ".join(w + [random.choice(vocabulary) for _ in range(random.randint(0, 30))]) + "\n"))
    return [*out, (300, None), (301, ""), (302, "x " * 40), (303, "y " * 35), (304, "z " * 36), (304, "z " * 36)]


#: Names that operators might use themselves.
CLASH = ["_score", "_may", "_name", "_no_source", "_pair", "_id", "_copy", "_end0", "_gone", "_key0", "_hash", "_place0", "_none", "_known", "_digest", "_whole", "_order"]


def test_stages_keep_columns_of_any_name_and_type(spark, toxic):  # noqa: ANN001
    same = "one two three four five six seven eight nine ten eleven twelve " * 3
    rows = [(1, same), (2, same + "x"), (3, same), (3, same), (4, "another text"), (None, None), (None, "of no one")]
    docs = docs_of(spark, rows).withColumns({c: F.lit(f"own {c}") for c in CLASH}).withColumn("map", F.create_map(F.lit("k"), "doc_id"))
    _, labels = toxic[0], toxic[1]
    for kept in (exact.without_copies(docs, "largest"), near.without_near_copies(docs, 80, 5), mixing.mixed(docs), toxicity.without_toxic(docs, labels)):
        assert kept.columns == docs.columns
        got = kept.collect()
        assert got and all(r[c] == f"own {c}" for r in got for c in CLASH) and all(r["map"] == {"k": r["doc_id"]} for r in got)
    assert sorted(r["doc_id"] or 0 for r in exact.without_copies(docs, "largest").collect()) == [0, 0, 2, 3, 4]


@pytest.mark.parametrize(("seed", "flush", "cells"), [(1, 500, None), (2, 250_000, None), (3, 500, 1 << 10)])
def test_removal_is_that_of_brute_force(spark, monkeypatch, seed, flush, cells):  # noqa: ANN001
    monkeypatch.setattr(substrings, "FLUSH", flush)
    if cells:  # a sketch that is much too small loses nothing
        monkeypatch.setattr(substrings, "MOST_CELLS", cells)
    rows = repeats(seed)
    got = substrings.without_repeats(docs_of(spark, rows, 4), with_text=True).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_removal(rows)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_rows_with_one_short_hash_keep_their_own_words(spark):  # noqa: ANN001
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(None, f"{passage} s213080"), (None, "z33747"), (1, passage), (None, " ".join(f"q{k}" for k in range(81)))]
    got = substrings.without_repeats(docs_of(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_removal(rows)


def test_removal_of_documents(spark, small, odd, empty):  # noqa: ANN001
    assert Counter(map(tuple, registered.op9_substring_dedup(spark, SMALL).collect())) == brute_removal(small)
    assert Counter(map(tuple, substrings.without_repeats(odd).collect())) == brute_removal(ODD)
    assert substrings.without_repeats(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 40))
def test_run_hashes_tell_runs_apart(values, size):  # noqa: ANN001
    x = np.array(values, np.uint64)
    got = substrings.run_hashes(x, size)
    runs = [tuple(values[k : k + size]) for k in range(len(values) - size + 1)]
    assert len(got) == len(runs) and len({(r, h) for r, h in zip(runs, got.tolist(), strict=True)}) == len(set(runs)) == len(set(got.tolist()))
    assert substrings.sliding(x, size, np.minimum).tolist()[: len(runs)] == [min(r) for r in runs]


# 10 toxicity


def toxic_corpus(n: int, seed: int) -> list[tuple[int, str, int]]:
    random.seed(seed)
    parts = ["an", "er", "the", "on", "re", "at", "ing", "en", "ou", "is", "or", "ti"]
    word = lambda: "".join(random.choice(parts) for _ in range(random.randint(1, 4)))
    out = []
    for i in range(n):
        w, bad = [word() for _ in range(random.randint(5, 120))], random.random() < 0.25
        for _ in range(random.randint(1, 4) if bad else 0):
            w.insert(random.randrange(len(w)), random.choice(["blockhead", "nitwit", "dimwit", "scoundrel"]))
        out.append((i, " ".join(w) + ".", int(bad)))
    return out


@pytest.fixture(scope="module")
def toxic(spark):  # noqa: ANN001, ANN201
    rows = toxic_corpus(900, 5)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, toxicity.trained(docs, labels)


def test_held_out_accuracy(spark, toxic):  # noqa: ANN001
    docs, labels, model = toxic
    rows = toxicity.scored(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == r["toxic"] for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)


def test_gaps_and_insertions_are_close(toxic):  # noqa: ANN001
    model = toxic[2]
    plain, gapped, other = (model.scores(pa.array([f"the ring {w} on there"])) for w in ("blockhead", "b.l.o.c.k.h.e.a.d", "thererin"))
    assert plain[0] >= 0.7 > other[0]
    assert model.units(pa.array(["blo-ckhead", "bloock head", "thererin"]))[0] > 0 > model.units(pa.array(["thererin"]))[0]
    assert model.scores(pa.array(["on n i t w i t the"]))[0] == pytest.approx(model.scores(pa.array(["on the nitwit"]))[0])
    assert gapped[0] > other[0]


def brute_features(unit: str) -> Counter:
    """Gapped subsequences of three letters, each occurrence weighted by its gaps."""
    letters = [c if c.isalpha() else None for c in unit.lower()]
    out = Counter()
    for i, j, k in itertools.combinations(range(len(letters)), 3):
        if k - i < toxicity.SPAN and None not in (found := (letters[i], letters[j], letters[k])):
            out[found] += toxicity.DECAY ** (k - i - 2)
    return out


def brute_length(unit: str) -> float:
    """The root of the squared weights of a unit's occurrences."""
    letters = [c.isalpha() for c in unit.lower()]
    spans = [k - i for i, j, k in itertools.combinations(range(len(letters)), 3) if k - i < toxicity.SPAN and letters[i] and letters[j] and letters[k]]
    return sum(toxicity.DECAY ** (2 * (s - 2)) for s in spans) ** 0.5


UNITS = ["stupid", "st-u.pid", "sstuppid", "s t u p i d", "kind", "abcabcabc", "a-b-c-d", "xyz", "stopped", "aaaa"]


def test_the_kernel_is_that_of_brute_force():  # noqa: ANN201
    columns, _, _ = toxicity.features(pa.array(UNITS))
    got = columns.T @ columns
    for a, x in enumerate(UNITS):
        for b, y in enumerate(UNITS):
            p, q = brute_features(x), brute_features(y)
            wanted = sum(p[k] * q[k] for k in p) / (brute_length(x) * brute_length(y))
            assert got[a, b] == pytest.approx(wanted, rel=1e-4), (x, y)


def test_the_folded_table_gives_the_sum_over_landmarks():  # noqa: ANN201
    columns, used, _ = toxicity.features(pa.array(UNITS[:6]))
    weights = np.linspace(-1, 1, 6)
    table = np.zeros(toxicity.SYMBOLS**3, np.float32)
    table[used] = columns[:-1] @ weights.astype(np.float32)
    folded = toxicity.raw(pa.array(UNITS), table)
    for k, x in enumerate(UNITS):
        p = brute_features(x)
        plain = 0.0
        for w, y in zip(weights, UNITS[:6], strict=True):
            q = brute_features(y)
            plain += w * sum(p[t] * q[t] for t in p) / (brute_length(x) * brute_length(y))
        assert folded[k] == pytest.approx(plain, rel=1e-3, abs=1e-5)


def test_the_machine_is_a_minimum_of_its_loss():  # noqa: ANN201
    random_ = np.random.default_rng(4)
    x = random_.normal(size=(300, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + random_.normal(size=300) > 0.3, 1.0, -1.0)
    weight = random_.uniform(0.1, 1, 300) / 300
    w = toxicity._machine(x, y, weight)
    one = np.concatenate([x, np.ones((300, 1))], 1)
    keep = np.array([1e-3] * 5 + [1e-8])
    loss = lambda v: (keep * v * v).sum() + (weight * np.maximum(0, 1 - y * (one @ v)) ** 2).sum()
    for k in range(6):
        for step in (-1e-3, 1e-3):
            assert loss(w) <= loss(w + step * np.eye(6)[k])
    v = np.zeros(6)
    for _ in range(20_000):  # plain descent comes to the same place
        inside = np.maximum(0, 1 - y * (one @ v))
        v -= 0.2 * (2 * keep * v - 2 * (weight * inside * y) @ one)
    assert np.allclose(v, w, atol=1e-3)


def test_labels_are_never_inputs(toxic):  # noqa: ANN001
    docs, labels, model = toxic
    again = toxicity.trained(docs, labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(again.table, model.table) and again.logistic == model.logistic


def test_odd_tables_are_scored(spark, toxic, odd, empty):  # noqa: ANN001
    _, labels, model = toxic
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == len(ODD) and len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1 and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.toxicity(empty, labels).count() == 0 and {r["score"] < 1e-9 for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {True}
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_the_machine_is_fitted_away_from_the_driver(toxic, monkeypatch):  # noqa: ANN001
    docs, labels, model = toxic
    rows = toxicity.sample(docs, labels)
    text = rows["text"].combine_chunks()
    here = toxicity.fit(text, rows["toxic"].to_numpy().astype(bool))
    assert np.allclose(here.scores(text), model.scores(text), atol=1e-4)
    for name in ("fit", "sample"):
        monkeypatch.setattr(toxicity, name, None)  # of the driver's module only; workers import their own
    again = toxicity.trained(docs, labels)
    assert np.array_equal(again.table, model.table) and (again.offset, again.logistic) == (model.offset, model.logistic)


def test_no_text_identifier_or_class_shuts_out_the_sample(spark, toxic):  # noqa: ANN001
    docs, labels, _ = toxic
    whole = toxicity.sample(docs, labels)
    assert whole.num_rows == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(900)) and 0 < sum(whole["toxic"].to_pylist()) < whole.num_rows
    trained_on = [i for i in range(900, 1200) if zlib.crc32(str(i).encode()) % 3 != 1]
    first = spark.createDataFrame([(i,) for i in trained_on], "doc_id long").orderBy(F.xxhash64("doc_id")).first()[0]  # leads the order of the new identifiers
    huge = spark.createDataFrame([(first, "huge word " * 1_300_000)], "doc_id long, text string")
    more = labels.unionByName(spark.createDataFrame([(first, 1, 0)], labels.schema))
    assert toxicity.sample(docs.unionByName(huge), more).num_rows == whole.num_rows
    often = spark.range(200).select(F.lit(first).alias("doc_id"), F.repeat(F.lit("often word "), 9000).alias("text"))
    assert toxicity.sample(docs.unionByName(often), more).num_rows == whole.num_rows + 1
    # the other class's bound and texts that don't count take no places
    few = toxicity.sample(docs, labels, most_bytes=sum(len(t) for t, y in zip(whole["text"].to_pylist(), whole["toxic"].to_pylist(), strict=True) if y))
    assert sum(few["toxic"].to_pylist()) == sum(whole["toxic"].to_pylist()) and few.num_rows < whole.num_rows
    absent = labels.unionByName(spark.createDataFrame([(i, 1, 1) for i in range(2000, 4000)], labels.schema))
    assert toxicity.sample(docs, absent, toxic=50, clean=50).num_rows == 100


# the pipeline


def test_the_pipeline_against_brute_force(spark):  # noqa: ANN001
    pipeline = pytest.importorskip("corpus_pipeline")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [tuple(r) for r in docs.collect()]
    for (name, stage), follow in zip(pipeline.STAGES[:-1], range(4), strict=False):
        docs = stage(spark, spark.createDataFrame(kept, DOC), SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = [tuple(r) for r in docs.collect()]
        pairs = [r[:2] for r in kept]
        if name == "exact dedup":
            want = {(i, t) for i, t in pairs if i == max(j for j, u in pairs if low(u) == low(t))}
            assert sorted(r[:2] for r in rows) == sorted(want)
        elif name == "near dedup":
            assert sorted(r[0] for r in rows) == sorted(i for i, (_, _, c, k) in brute_components(pairs).items() if k)
        elif name == "mixing":
            sizes = Counter()
            for r in kept:
                sizes[r[3]] += len(words(r[1]))
            taken = Counter()
            for r in rows:
                taken[r[3]] += len(words(r[1]))
            assert all(abs(taken[s] - t) <= max(len(words(r[1])) for r in kept if r[3] == s) for s, t in brute_targets(sizes).items())
        else:
            assert set(rows) <= set(kept) and follow == 0
        kept = rows
    check_packed(pipeline.STAGES[-1][1](spark, spark.createDataFrame(kept, DOC), SMALL).collect(), [r[:2] for r in kept])
    assert pipeline.run(spark, SMALL).count() > 0 and json.dumps(names) and Path(SMALL).is_dir()
