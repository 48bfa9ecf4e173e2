"""Operators against brute force on odd rows and on a random corpus."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tracewright.llm import digest, hmm, langid, licenses, mixing, pieces, quality, simhash, suffixes
from tracewright.llm.common import doc_hash_remainder
from tracewright.llm.queries import tokenizer_path

BLANKS = r"[^\x20\x09-\x0D]+"
SMALL = "/root/testdata/sf0.001/documents.parquet"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["odd", "real"])
def docs(request, spark, odd):
    return odd if request.param == "odd" else spark.read.parquet(SMALL)


# --- 2 -----------------------------------------------------------------------------------------------------------

def slow_fingerprint(text, n=4):
    words = re.findall(BLANKS, lower(text))
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(codes, radius=4):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c
    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in listed}


def test_simhash(docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    rows = [(i, slow_fingerprint(t)) for i, t in texts(docs)]
    of = slow_components([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    assert got == sorted((i is None, i or 0, f"{f:016x}", least.get(of[f])) for i, f in rows)


def test_links_of_dense_codes(spark, monkeypatch):
    """A large group of near copies, cut into parts, and chains; every layout finds the same components."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    codes = {centre}
    for _ in range(600):
        c = centre
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            c ^= 1 << int(b)
        codes.add(c)
    c = int(rng.integers(0, 1 << 62))
    for _ in range(30):
        for b in rng.integers(0, 64, 4):
            c ^= 1 << int(b)
        codes.add(c)
    codes |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    want = slow_components(list(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")

    def groups(found):
        by = defaultdict(set)
        for r in found.collect():
            by[r.root].add(r.node % (1 << 64))
        return {frozenset(g) for g in by.values()}
    by = defaultdict(set)
    for code, root in want.items():
        by[root].add(code)
    expected = {frozenset(g) for g in by.values() if len(g) > 1}
    for shard, mean in ((2048, 64), (128, 64), (128, 0)):
        monkeypatch.setattr(simhash, "SHARD", shard)
        monkeypatch.setattr(simhash, "SHARD_MEAN", mean)
        assert groups(simhash.components(simhash.links(df))) == expected


def slow_one_of_each(rows):
    """(doc_id, text) of the first row by doc_id, nulls last, of every component; texts tell the rows of an id apart."""
    of, best = slow_components([slow_fingerprint(t) for _, t in rows]), {}
    for i, t in rows:
        c = of[slow_fingerprint(t)]
        best.setdefault(c, []).append((i is None, i or 0, t))
    return {c: [x for x in found if x[:2] == min(y[:2] for y in found)] for c, found in best.items()}


def test_one_of_each(docs, nothing):
    """One row of each group stays, with all its columns, whatever their names; of ties any one."""
    renamed = docs if "a" in docs.columns else docs.withColumnsRenamed({"lang": "a", "n_chars": "_b"})
    kept = simhash.one_of_each(renamed)
    assert kept.columns == renamed.columns and kept.schema == renamed.schema
    want, of = slow_one_of_each(texts(docs)), slow_components([slow_fingerprint(t) for _, t in texts(docs)])
    got = defaultdict(list)
    for r in kept.collect():
        got[of[slow_fingerprint(r.text)]].append((r.doc_id is None, r.doc_id or 0, r.text))
    assert got.keys() == want.keys() and all(len(x) == 1 and x[0] in want[c] for c, x in got.items())
    rows = Counter(tuple(r) for r in renamed.collect())
    assert all(rows[tuple(r)] for r in kept.collect()) and simhash.one_of_each(nothing).count() == 0


def test_one_of_each_with_null_and_repeated_ids(spark):
    """Null ids are copies like others; a document with another text stays if its id is a kept one's."""
    word = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, 80))
    a, b, c, d = map(word, range(4))
    rows = [(1, a), (None, a), (1, b), (2, b), (None, c), (None, c.upper()), (3, d), (3, d), (None, None), (None, None), (7, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r.doc_id, r.text and r.text.lower()) for r in kept)
    assert got == Counter([(1, a), (1, b), (None, c), (3, d), (7, "")])


# --- 3 -----------------------------------------------------------------------------------------------------------

def test_licenses(docs):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.labelled(docs).collect()}
    want = set()
    for i, t in texts(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, x) for p, x in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        want.add((i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == want
    assert licenses.labelled(docs).count() == docs.count()


def test_license_notices(spark):
    mit, gpl = licenses.NOTICES["mit"].split(), licenses.NOTICES["gpl"].split()
    changed = mit[:10] + ["really"] + mit[10:30] + mit[32:60] + ["or", "so"] + mit[60:]
    rows = [(1, " ".join(mit)), (2, "before, " + " ".join(changed).upper() + ", after"), (3, " ".join(mit[:20])),
            (4, "of the and of the and to the " * 400), (5, " ".join(gpl[:70]) + " x " + " ".join(mit))]
    found = {r.doc_id: r for r in licenses.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i].labels for i in range(1, 6)] == ["mit", "mit", "", "", "gpl,mit"]
    assert found[1].score == 1 and 0 < found[3].score < 0.5 and found[2].n_base == 0


# --- 4 -----------------------------------------------------------------------------------------------------------

def test_digest(docs):
    got = digest.with_next(docs).collect()
    assert len(got) == docs.count()
    order = {}
    for i, t in texts(docs):
        order.setdefault(i, set()).add(t or "")
    if None not in order and all(len(v) == 1 for v in order.values()):
        ids = sorted(order, reverse=True)
        after = {i: ids[(n + 1) % len(ids)] for n, i in enumerate(ids)}
        for r in got:
            t, x = next(iter(order[r.doc_id])), next(iter(order[after[r.doc_id]]))
            new = t[:len(t) - len(t) // 2] + x[:len(t) // 2]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert r.fingerprint == digest.digest(t) and r.edited_fingerprint == digest.digest(new)
            assert r.near_next == digest.likeness(digest.digest(t), digest.digest(x))
        assert np.mean([r.near_edited >= r.near_next for r in got]) > 0.95
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_digest_pieces(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(0, 256, 5000, np.uint8))
    whole = digest.bucket_counts(data)
    monkeypatch.setattr(digest, "PIECE", 700)
    assert (digest.bucket_counts(data) == whole).all() and whole.sum() == 6 * (5000 - 4)
    assert digest.digest("") == digest.digest("") and digest.likeness(digest.digest("abc"), digest.digest("abc")) == 1


# --- 5 -----------------------------------------------------------------------------------------------------------

def test_hmm_base_score(docs):
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in hmm.score(docs, 3, 64, 2).collect())
    tokens = lambda t: re.findall(BLANKS, lower(t)) + [" "]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in texts(docs) if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in texts(docs):
        w = tokens(t)
        s = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(s, 4)] += 1
    assert got == want


def test_hmm_recursions():
    """Lock step against sums over all paths, and expected counts against pair probabilities."""
    rng = np.random.default_rng(5)
    k, n = 3, 6
    start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
    emit = rng.dirichlet(np.ones(n), k).T
    sizes = np.array([4, 1, 5, 2])
    symbols = rng.integers(0, n, sizes.sum())
    steps = hmm.Lockstep(symbols, sizes)
    begins, moves, emits = np.zeros((4, k)), np.zeros((k, k)), np.zeros((n, k))
    steps.expected(np.tile(start, (4, 1)), move, emit, begins, moves, emits)
    want_moves, want_emits, want_logs, at = np.zeros((k, k)), np.zeros((n, k)), [], 0
    for size in sizes:
        own, at = symbols[at:at + size], at + size
        total, m, e = 0.0, np.zeros((k, k)), np.zeros((n, k))
        for path in np.ndindex(*[k] * size):
            p = start[path[0]] * emit[own[0], path[0]]
            for t in range(1, size):
                p *= move[path[t - 1], path[t]] * emit[own[t], path[t]]
            total += p
            for t in range(size):
                e[own[t], path[t]] += p
                if t:
                    m[path[t - 1], path[t]] += p
        want_moves, want_emits = want_moves + m / total, want_emits + e / total
        want_logs.append(math.log10(total))
    assert np.allclose(moves * move, want_moves) and np.allclose(emits, want_emits)
    assert np.allclose(steps.log10(start, move, emit), want_logs)


def test_hmm_learns(spark):
    rows = hmm.score(spark.read.parquet(SMALL), 4, 512, 4).toPandas()
    assert rows.score.sum() > rows.base_score.sum() and rows[rows.held_out].score.sum() > rows[rows.held_out].base_score.sum()


# --- 6 -----------------------------------------------------------------------------------------------------------

def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = doc_hash_remainder(4) == 2
    model = langid.train(docs, ~held)
    found = langid.identify(docs.where(held), model, ["doc_id", "lang"]).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()


def test_language_odd(odd, nothing):
    from pyspark.sql import functions as F
    model = langid.train(odd, F.lit(True))
    assert model.languages == ["de", "en", "fr", "ja"]
    rows = langid.identify(odd, model, ["doc_id", "score"]).collect()
    assert rows[0].asDict().keys() == {"doc_id", "lang_pred", "score"}
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (3, 4, 5, 6)] == ["und"] * 4 and by[3].score == 0 and by[7].lang_pred == "de"
    empty = langid.train(nothing, F.lit(True))
    assert empty.languages == [] and {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} == {"clash"}


def test_language_pieces(monkeypatch):
    text = "".join(map(chr, np.random.default_rng(2).integers(97, 400, 3000)))
    whole = langid.bucket_counts(text)
    monkeypatch.setattr(langid, "PIECE", 101)
    assert (langid.bucket_counts(text) == whole).all()


# --- 8 -----------------------------------------------------------------------------------------------------------

def slow_cut(rows, length=100):
    """Per id: bytes, removed, runs, digest of what is left."""
    seen, out = set(), {}
    for i, t in sorted(dict(rows).items(), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if data[p:p + length] in seen:
                gone[p:p + length] = True
            seen.add(data[p:p + length])
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[i] = (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest())
    return out


def check_cut(docs):
    want = slow_cut(texts(docs))
    got = suffixes.cut(docs, ["doc_id"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_suffixes_real(spark):
    check_cut(spark.read.parquet(SMALL))


def test_suffixes_odd(odd, nothing):
    check_cut(odd.where("doc_id is not null or text is not null"))
    assert suffixes.cut(nothing).count() == 0
    kept = suffixes.cut(odd)
    assert set(odd.columns) <= set(kept.columns) and {r.spans for r in kept.collect()} == {"clash"}


@pytest.mark.parametrize("hot", [2_000, 5])
def test_suffixes_adversarial(spark, monkeypatch, hot):
    """Few letters, periodic texts, passages in changing surroundings, many buckets; with and without hot anchors."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = np.random.default_rng(8)
    word = lambda n, letters="ab": "".join(rng.choice(list(letters), n))
    passage = word(260, "abcdefgh ")
    rows = [(i, word(int(rng.integers(0, 40)), "xyz ") + passage[int(rng.integers(0, 80)):int(rng.integers(150, 260))] + word(30, "xyz "))
            for i in range(60)]
    rows += [(100 + i, "ab" * int(rng.integers(40, 120))) for i in range(5)] + [(110, "a" * 500), (111, "a" * 99), (112, "a" * 100)]
    rows += [(120 + i, word(400, "ab")) for i in range(3)] + [(130, "é" * 120), (131, "xé" + "é" * 70)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check_cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_suffixes_of_null_and_repeated_ids(spark):
    """Every row is a document: spans of one null-id text don't reach others, and repeats at equal places are found."""
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, own = word(150), [word(400) for _ in range(6)]
    same, twice = word(300), word(200)
    rows = [(None, own[0]), (None, own[1][:20] + passage + own[1][20:]), (None, own[2][:20] + passage + own[2][20:]), (None, None),
            (None, same), (None, same), (None, same), (5, own[3] + passage), (5, own[4]), (5, own[5]), (6, twice), (6, twice)]
    got = suffixes.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ["doc_id", "text"]).collect()
    removed = Counter((r.doc_id, r.text, r.n_removed) for r in got)
    shifted = sorted((len(r.text) - r.n_removed) for r in got if r.doc_id is None and r.text and passage in r.text)
    assert len(got) == len(rows) and shifted[1] == 550 and 395 <= shifted[0] <= 400
    assert all(removed[i, t, 0] == 1 for i, t in [(None, own[0]), (None, None), (5, own[4]), (5, own[5])])
    assert (removed[None, same, 0], removed[None, same, 300]) == (1, 2) and (removed[6, twice, 0], removed[6, twice, 200]) == (1, 1)
    assert all(150 <= r.n_removed <= 155 and r.kept_text.startswith(own[3][:390]) for r in got if r.text == own[3] + passage)


# --- 9 -----------------------------------------------------------------------------------------------------------

def slow_mix(rows):
    sizes = [(i, s, len(re.findall(BLANKS, t or "")), int(hashlib.md5(
        f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)) for i, t, s in rows]
    per = defaultdict(int)
    for _, s, n, _ in sizes:
        per[s] += n
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(per.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 2 * per[s]]
        target.update(share)
        if not over:
            break
        for s in over:
            target[s] = 2.0 * per[s]
            full.add(s)
            left -= target[s]
    out = []
    for i, s, n, h in sizes:
        copies = int(target[s] // per[s] + 1e-12) if per[s] else 0
        rest = target[s] - copies * per[s]
        before = sum(m for _, x, m, g in sizes if x == s and g < h)
        tied = sum(m for _, x, m, g in sizes if x == s and g == h)
        out.append((i is None, i or 0, n, per[s], round(target[s], 6), n * (copies + (2 * before + tied <= 2 * rest))))
    return sorted(out)


def test_mix(docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.source_size, round(r.target, 6), r.taken)
                 for r in mixing.mixed(mixing.sized(docs)).collect())
    assert got == slow_mix([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()])


def test_mix_rows(docs):
    taken = sum(r.taken for r in mixing.mixed(mixing.sized(docs)).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(BLANKS, r.text or "")) for r in mixed.select("text").collect()) == taken


# --- 10 ----------------------------------------------------------------------------------------------------------

def test_pieces(docs):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    rows = pieces.encode(docs, tokenizer_path(), ["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        proto = library.encode(r.text or "", return_type="proto")
        assert r.ids == [p.id for p in proto.pieces] and r.decoded == library.decode(r.ids)
        if not any(library.is_byte(i) for i in r.ids):
            assert r.ends == [p.end for p in proto.pieces]
        assert r.ends == sorted(r.ends) and (not r.ids or r.ends[-1] == len((r.text or "").encode()))


def character_map(rules):
    """A compiled map for a few rules: a double-array trie laid out greedily, then the replacements."""
    strings, offset = b"", {}
    for key, new in rules.items():
        offset[key] = len(strings)
        strings += new + b"\0"
    trie = {}
    for key in rules:
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = offset[key]
    units, used = {0: 0}, {0}

    def place(node, at):
        labels = [0 if b is None else b for b in node]
        base = next(b for b in range(256, 1 << 20, 256) if all((at ^ b ^ x) not in used for x in labels))
        units[at] = units[at] | (base >> 8) << 10 | 1 << 9 | (0x100 if None in node else 0)
        for x in labels:
            used.add(at ^ base ^ x)
        for b, child in node.items():
            spot = at ^ base ^ (b or 0)
            if b is None:
                units[spot] = 1 << 31 | child
            else:
                units[spot] = b
                place(child, spot)
    place(trie, 0)
    table = np.zeros(max(units) + 257, "<u4")
    for i, u in units.items():
        table[i] = u
    return len(table.tobytes()).to_bytes(4, "little") + table.tobytes() + strings


def test_character_map():
    rules = {"ﬁ".encode(): b"fi", "ﬁ!".encode(): b"F", "Å".encode(): "Å".encode(), b"\t": b" ", "​".encode(): b""}
    found = pieces.CharacterMap(character_map(rules))
    source = "ﬁ! ﬁxÅ\t​".encode()
    assert found.longest(source, 0) == (4, b"F") and found.longest(source, 5) == (3, b"fi") and found.longest(source, 4) is None
    assert found.longest(source, 9) == (2, "Å".encode()) and found.longest("​".encode(), 0) == (3, b"")
    encoder = pieces.Encoder(open(tokenizer_path(), "rb").read())
    encoder.map = found
    normal, align = encoder.normalise("ﬁ!aﬁ\tÅ")
    assert normal.decode() == "▁Fafi▁Å" and align == [0, 0, 0, 0, 4, 5, 5, 8, 8, 8, 9, 9, 9 + 2][:len(normal)] + [11]


# --- 1 -----------------------------------------------------------------------------------------------------------

def test_quality_separates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    good, bad = rows[(rows.quality == 1) & (rows.toxic == 0)], rows[rows.quality == 0]
    assert good.keep.mean() > 0.95 and bad.keep.mean() < 0.05


def slow_kneser_ney(texts, queries):
    """Interpolated modified Kneser-Ney over characters, with dictionaries; log10 of each text's probability."""
    n = quality.ORDER
    counts = {n: Counter()}
    for t in texts:
        line = "\0" * (n - 1) + t
        counts[n].update(line[i:i + n] for i in range(len(t)))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    symbols = {c for t in texts for c in t}
    off = {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in range(1, 5))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            off[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        else:
            off[k] = [0.5, 1.0, 1.5]
    total, taken = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for g, v in c.items():
            total[k, g[:-1]] += v
            taken[k, g[:-1]] += off[k][min(v, 3) - 1]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(symbols) + 2)
        h = (k, gram[:-1])
        if h not in total:
            return p(gram[1:])
        v = counts[k][gram]
        own = v - off[k][min(v, 3) - 1] if v else 0
        return own / total[h] + taken[h] / total[h] * p(gram[1:])
    return [sum(math.log10(p(("\0" * (n - 1) + t)[i:i + n])) for i in range(len(t))) for t in queries]


def test_quality_model(spark, monkeypatch):
    train = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "the mat the cat"] * 3 + ["on the the dog mat"]
    queries = ["the cat", "zzz", "dog on mat", "", "the the 日本"]
    t = spark.createDataFrame([(x,) for x in train], "text string")
    symbols = quality.alphabet(t)
    grams, histories, unknown = quality.model(quality.gram_counts(t, symbols), int(symbols.max()) - 1)
    docs = spark.createDataFrame([(i, q, "en") for i, q in enumerate([*queries, "dog on mat"])], "doc_id long, text string, lang string")
    want = slow_kneser_ney(train, [*queries, "dog on mat"])
    for size in (2_000_000, 40):
        monkeypatch.setattr(quality, "SHARD_ROWS", size)
        parts = quality.shards(grams, histories)
        assert (len(parts) > 1) == (size == 40)
        got = {r.doc_id: r.perplexity for r in quality.perplexities(docs, symbols, parts, unknown).collect()}
        for i, q in enumerate([*queries, "dog on mat"]):
            assert got[i] is None if not q else got[i] == pytest.approx(10 ** (-want[i] / len(q)), rel=1e-4)


def test_quality_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.perplexity is None for r in rows if r.doc_id in (3, 4))
    assert quality.classify(nothing, labels).count() == 0
    assert all(r.keep for r in quality.classify(odd, labels.where("quality = 0")).collect())


# --- all on nothing ----------------------------------------------------------------------------------------------

def test_empty_tables(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and licenses.labelled(nothing).count() == 0
    assert digest.with_next(nothing).count() == 0 and hmm.score(nothing, 2, 16, 1).count() == 0
    assert mixing.mixed(mixing.sized(nothing)).count() == 0 and mixing.mix(nothing).count() == 0
    assert pieces.encode(nothing, tokenizer_path()).count() == 0 and simhash.one_of_each(nothing).count() == 0
