"""The registered queries, all columns, over a small table of odd documents, against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import mixing, queries

LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}
ENGLISH = "the people of this town were thinking about whether they should have another meeting with their neighbours".split()
GERMAN = "die leute dieser stadt überlegten ob sie noch eine weitere sitzung mit ihren nachbarn haben sollten".split()


def made():
    draw = random.Random(11)
    rows = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        text = " ".join(draw.choices(ENGLISH if lang == "en" else GERMAN, k=draw.randint(5, 60)))
        if i % 12 == 0:
            text += f' api_key = "k{i}abcdef9", AKIA{"Z7" * 10} {"0f3a" * 8}'
        rows.append((i, text, lang, f"s{i % 5}"))
    copies = [(300 + i, rows[4][1], "en", "s0") for i in range(30)] + [(7, rows[7][1], "de", "s2")] * 25
    odd = [
        (400, None, "en", "s1"), (401, "", None, "s1"), (402, " \t\r\n", "de", None), (403, "12 ## ²", "en", "s3"), (404, "日本語のテキスト。かな カナ 한글 Ελληνικά العربية 😀", None, "s4"),
        (405, "the " * 20_000, "en", "s0"), (None, "no id here at all", "en", "s1"), (None, None, None, None), (406, "<|endoftext|> naïve café it's 2's", "en", "s2"), (-3, "One", "en", "s0"),
    ]
    return rows + copies + odd


ROWS = made()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    frame.repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def run(spark, folder, name, columns):
    df = next(fn for key, fn in queries.QUERIES.items() if key.startswith(f"{name}_"))(spark, folder)
    assert df.columns[: len(columns)] == columns
    return df.collect()


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ids_of(name, text):
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


def test_op1(spark, folder):
    got = run(spark, folder, "op1", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    want = []
    for i, t, *_ in ROWS:
        ids = ids_of("word_bpe_49k.json", t)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY["word_bpe_49k.json"].decode(ids, skip_special_tokens=False))))
    same(got, want)


def test_op2(spark, folder):
    got = run(spark, folder, "op2", ["doc_id", "held_out", "lang_pred", "score"])
    lang = {(i, t): l for i, t, l, _ in ROWS}
    assert len(got) == len(ROWS)
    number = collections.Counter()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        number[r.doc_id] += 1
    for r in got:
        if r.doc_id in (400, 401, 402):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and 0 <= r.doc_id < 300:
            assert 0 < r.score <= 1 and r.lang_pred in ("en", "de")
    clean = [r for r in got if r.doc_id is not None and 0 <= r.doc_id < 300 and r.held_out]
    assert clean and sum(r.lang_pred == ("en", "de")[r.doc_id % 2] for r in clean) >= 0.98 * len(clean)
    assert number == collections.Counter(i for i, *_ in ROWS) and len(lang) > 200


def test_op6(spark, folder):
    got = run(spark, folder, "op6", ["doc_id", "size", "source_size", "target", "taken"])
    assert sorted(map(repr, got)) == sorted(map(repr, run(spark, folder, "op6", ["doc_id", "size", "source_size", "target", "taken"])))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, _, s in ROWS:
        sizes[s] += size(t)
    goal = mixing.targets(dict(sizes))
    same([(r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got], [(i, size(t), sizes[s], round(goal[s], 6)) for i, t, _, s in ROWS])
    taken = collections.Counter()
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s in sizes:
        largest = max(size(t) for _, t, _, x in ROWS if x == s)
        assert abs(taken[sizes[s], round(goal[s], 6)] - goal[s]) <= min(largest, 60 if largest < 20_000 else largest), s


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op7(spark, folder):
    got = run(spark, folder, "op7", ["doc_id", "fingerprint", "component_id"])
    prints = {t: fingerprint(t) for _, t, *_ in ROWS}
    parent = {p: p for p in prints.values()}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(list(parent), 2):
        if bin(a ^ b).count("1") <= 3:
            parent[root(a)] = root(b)
    least = {}
    for i, t, *_ in ROWS:
        if i is not None:
            g = root(prints[t])
            least[g] = min(least.get(g, i), i)
    same(got, [(i, f"{prints[t]:016x}", least.get(root(prints[t]))) for i, t, *_ in ROWS])


def test_op8(spark, folder):
    got = run(spark, folder, "op8", ["doc_id", "start", "n_tokens", "ids_crc32"])
    ids = {(i, t): [*ids_of("word_bpe_49k.json", t), 2] for i, t, *_ in ROWS}
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(ids[i, t]), zlib.crc32(np.array(ids[i, t], "<u4").tobytes())) for i, t, *_ in ROWS])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)


def test_op9(spark, folder):
    got = run(spark, folder, "op9", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = ["assign", "access", "hex"]
    want = []
    for i, t, *_ in ROWS:
        found = [(m.start(), 0, m.end()) for m in re.finditer(pattern, t or "", re.I | re.A) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)]
        want.append((i, *[sum(k == n for _, k, _ in found) for n in range(3)], sha(",".join(listed)), tuple(listed)))
    same([(*r[:5], tuple(s for s in r.spans.split(",") if s and not s.startswith("random"))) for r in got], want)
    assert sum(r.n_hex for r in got) >= 20


def test_op10(spark, folder):
    got = run(spark, folder, "op10", ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    want = [(i, len((t or "").encode()), len(ids_of("byte_bpe_50k.json", t))) for i, t, *_ in ROWS]
    same(got, [(*w, w[2] > 1024) for w in want])
    assert sum(r.over_limit for r in got) == 1
