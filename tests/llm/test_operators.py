"""Each operator's query against a brute-force version on the smallest tables."""

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from barspark.llm import langid, queries, records
from barspark.llm.urlfilter import Rule, compile_rules

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn domains from


def table(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


def rows(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_op1_base_spans(spark, docs):
    got = rows(queries.op1_secret_battery(spark, SMALL))
    assert got.keys() == docs.keys()
    patterns = [
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", r"AKIA[A-Z0-9]+", 20),
        ("hex", r"[0-9a-f]+", 24),
    ]
    for doc, text in docs.items():
        found = []
        for order, (kind, pattern, least) in enumerate(patterns):
            for m in re.finditer(pattern, text):
                if len(m.group(m.lastindex or 0)) >= least:
                    found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        listed = [s for _, _, s in sorted(found)]
        assert got[doc].base_sha256 == sha(",".join(listed))
        assert set(listed) <= set(got[doc].spans.split(","))
        assert [got[doc].n_assign, got[doc].n_access, got[doc].n_hex] == [sum(s.startswith(k) for s in listed) for k in ("assign", "access", "hex")]


def test_op2_automaton_against_regular_expressions():
    rules = [Rule("block", "*.shop", "/a*b"), Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "*", "/*.exe")]
    machine = compile_rules(rules)
    rng = np.random.default_rng(3)
    hosts = ["example.org", "a.example.org", "x.shop", "q.x.shop", "org", "notorg", ""]
    urls = [h + p for h in hosts for p in ["", "/", "/es/", "/es/x.exe", "/ab", "/axxb/c", "/c.exe?"]] + ["".join(rng.choice(list("ab/.x"), 70)) for _ in range(200)]
    rank = np.arange(len(rules))
    got = machine.match([u.encode() for u in urls], rank)

    def plain(url):
        for number, rule in enumerate(rules):
            for pattern in rule.patterns:
                host, slash, path = pattern.partition("/")
                if re.fullmatch(re.escape(host).replace(r"\*", "[^/]*") + slash + re.escape(path).replace(r"\*", ".*"), url, re.S):
                    return number
        return -1

    assert got.tolist() == [plain(u) for u in urls]


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def test_op3_classes(spark, docs):
    sets = {d: shingles(t, 4) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = rows(queries.op3_minmax_neardup(spark, SMALL))
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_op4_recall_and_scores(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table("embeddings")}
    ids = np.array(sorted(vectors))
    base = np.stack([vectors[i] for i in ids])
    got = {}
    for r in queries.op4_multiprobe_ann(spark, SMALL).collect():
        got.setdefault(r.query_id, []).append(r)
    asked = [i for i in ids if i % 100 == 0]
    assert sorted(got) == asked
    met = total = 0
    for q in asked:
        apart = np.sqrt(((base - vectors[q]) ** 2).sum(1))
        best = [i for _, i in sorted((s, i) for s, i in zip(apart, ids) if i != q)][:10]
        found = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        assert all(r.score == pytest.approx(float(np.sqrt(((vectors[r.vec_id] - vectors[q]) ** 2).sum())), rel=1e-12) for r in found)
        met += len({r.vec_id for r in found} & set(best))
        total += len(best)
    assert met / total >= 0.9


def test_op5_hits(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item in table("benchmark"):
        words = word.findall(low(item["text"] or ""))
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item["item_id"]))
    sizes = {len(w) for w in windows}
    got = rows(queries.op5_winnow_decontam(spark, SMALL))
    for doc, text in docs.items():
        words, hit, items = word.findall(low(text)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if own := windows.get(tuple(words[i : i + size])):
                    items |= own
                    hit |= set(range(i, i + size))
        expected = (len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
        r = got[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_op6_round_trip_and_op9_counts(spark, docs):
    encode = tokenizer()
    got = rows(queries.op6_token_records(spark, SMALL))
    start, sizes = 0, []
    for doc in sorted(docs):
        ids = encode.encode(docs[doc], add_special_tokens=False).ids + [2]
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        sizes.append(len(ids))
    sizes = np.array(sizes)
    for r in queries.op9_length_histogram(spark, SMALL).collect():
        limit = r.n_tokens
        assert (r.n_docs, r.docs_from, r.tokens_from) == ((sizes == limit).sum(), (sizes >= limit).sum(), sizes[sizes >= limit].sum())
        assert r.truncated_total == np.minimum(sizes, limit).sum()
        assert r.quantile == pytest.approx((sizes <= limit).mean())


def test_op6_damage_is_noticed():
    data = records.frame(7, np.array([1, 2, 3], "<u2")) + records.frame(None, np.array([70000], "<u4"))
    assert [(d, i.tolist()) for d, i in records.frames(data)] == [(7, [1, 2, 3]), (None, [70000])]
    for at in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(broken)))


def test_op7_removed_bytes(spark, docs):
    seen, got = set(), rows(queries.op7_bwt_repeats(spark, SMALL))
    for doc in sorted(docs):
        data = docs[doc].encode()
        cover = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                cover[i : i + 100] = True
            seen.add(window)
        kept = np.frombuffer(data, np.uint8)[~cover].tobytes()
        runs = int((np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])) == 1).sum())
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(cover.sum()), runs, sha(kept))


def test_op8_meets_targets(spark):
    found = queries.op8_soft_mixing(spark, MIDDLE).collect()
    all_tokens = sum(r.n_tokens for r in found)
    assert all(r.rate >= 0 for r in found)
    assert all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in found)
    for name, share in (("good", 0.81), ("poor", 0.09), ("toxic", 0.0)):
        assert sum(r.n_tokens * r.rate * r[f"p_{name}"] for r in found) / all_tokens == pytest.approx(share, abs=0.01)


def test_op10_held_out_accuracy(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in table("documents")}
    got = rows(queries.op10_hierarchical_langid(spark, SMALL))
    assert {d: r.held_out for d, r in got.items()} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in docs}
    judged = [r for d, r in got.items() if r.held_out and lang[d] is not None and any(c.isalpha() for c in docs[d])]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) / len(judged) >= 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.lang_pred == langid.UNKNOWN for d, r in got.items() if not any(c.isalpha() for c in docs[d]))


def test_results_are_plain_values(spark):
    row = queries.op1_secret_battery(spark, SMALL).first().asDict()
    json.dumps(row)
