"""The operators against brute-force versions, on small fixtures with nulls, ties, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventmesa.llm import chosen_path, classlm, components, langid, minhash, mixing, packed, pii, queries, secrets, setlinks, warc, winnowing
from eventmesa.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "size long, row long, node long, copies int, found string"
rng = random.Random(3)
WORDS = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Lam", "mu", "nu", "xi", "é", "pi2"]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts, **more):
    rows = [(i, t, more.get("lang", {}).get(i), more.get("source", {}).get(i), None, 1, 2, 3, 4, "x") for i, t in texts]
    return spark.createDataFrame(rows, f"{SCHEMA}, {EXTRA}")


EDGES = [(0, None), (1, ""), (2, "one"), (3, "a b c"), (4, " \t\n"), (None, "no id here at all"), (5, "x " * 30_000), (6, "é" * 50_000)]


def test_secrets_match_the_patterns(spark):
    parts = ["token", "=", ":", "SECRET", '"', "'", " ", "AKIA", "A1B2" * 5, "abcdef1", "api_key", "password", "é", "ghp_" + "a" * 40, "0" * 13, "deadbeef" * 3, "-----BEGIN RSA PRIVATE KEY-----", "secret=token:abcdefgh"]
    texts = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(400)] + [(1000 + i, t) for i, t in EDGES if i is not None] + [(7, "token=abcdef"), (7, "token=abcdef")]
    got = Counter((r.doc_id, tuple((x.kind, x.start, x.end) for x in r.found)) for r in secrets.scan(frame(spark, texts)).collect())

    def brute(text):
        found = []
        for r, rule in enumerate(secrets.RULES):
            found += [(m.start(), r, m.end()) for m in re.finditer(rule.pattern, text or "", re.A) if len(m[rule.group]) >= rule.least]
        return tuple((secrets.RULES[r].kind, s, e) for s, r, e in sorted(found))

    assert got == Counter((i, brute(t)) for i, t in texts)
    assert secrets.scan(frame(spark, [])).count() == 0
    assert secrets.redact(frame(spark, [(1, "é token=abcdef!")])).first().text == "é [secret]!"


def brute_components(texts, k, percent):
    sets = []
    for _, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    part = list(range(len(texts)))

    def top(x):
        return x if part[x] == x else top(part[x])

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                part[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(texts)}


def families():
    r, texts = random.Random(8), [(i, t) for i, t in EDGES if i is not None]
    for f in range(12):
        base = prose(80, r).split()
        for _ in range(40 if f == 0 else 6):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(WORDS) + str(r.randrange(99))
            texts.append((100 + len(texts), " ".join(w)))
    return texts + [(900 + i, texts[-1][1]) for i in range(40)]


@pytest.mark.parametrize("search", [lambda d: chosen_path.near_duplicates(d, shingle=4), lambda d: minhash.near_copies(d, shingle=4)])
def test_near_duplicates_match_all_pairs(spark, search):
    texts = families()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in search(frame(spark, texts)).collect()}
    assert got == brute_components(texts, 4, 80)


def variants(n, changed, words=240, seed=5):
    """n texts of one base, each with its own words at `changed` places, far enough apart to break four shingles each."""
    r = random.Random(seed)
    base, out = [f"w{r.randrange(10**6)}" for _ in range(words)], []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(words // 4), changed):
            w[4 * at + 2] = f"v{i}x{at}"
        out.append(" ".join(w))
    return out


def links_of(texts, k=4):
    """All pairs by a matrix product: (i, j, similarity) of the alike ones."""
    names, rows = {}, []
    for t in texts:
        w = t.split()
        rows.append([names.setdefault(tuple(w[i : i + k]), len(names)) for i in range(len(w) - k + 1)])
    shared = [x for x, n in Counter(x for row in rows for x in row).items() if n > 1]
    at = {x: i for i, x in enumerate(shared)}
    m = np.zeros((len(texts), len(shared)), np.float32)
    for i, row in enumerate(rows):
        m[i, [at[x] for x in row if x in at]] = 1
    sizes, both = np.array([len(set(row)) for row in rows]), (m @ m.T).astype(int)
    likeness = both / (sizes[:, None] + sizes[None, :] - both)
    i, j = np.nonzero(np.triu(likeness >= 0.8, 1))
    return list(zip(i.tolist(), j.tolist(), likeness[i, j].tolist(), strict=True))


def test_near_duplicates_in_large_groups(spark):
    """1,500 texts of one base of which few are links, and 1,200 of another without any: no link of 0.8 to 0.85 is lost."""
    texts = variants(750, 3) + variants(750, 8) + variants(1200, 12, seed=6)
    near = links_of(texts)
    part = list(range(len(texts)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, j, _ in near:
        part[max(top(i), top(j))] = min(top(i), top(j))
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(frame(spark, list(enumerate(texts))), shingle=4).collect()}
    just = [(i, j) for i, j, x in near if x < 0.85]
    assert len(just) > 100 and sum(got[i] == got[j] for i, j in just) >= 0.99 * len(just)
    assert all(got[i] == i for i in range(1500, 2700)) and sum(got[i] != top(i) for i in range(len(texts))) <= 3


@pytest.mark.parametrize("search", [lambda d: chosen_path.near_duplicates(d, shingle=4), lambda d: minhash.near_copies(d, shingle=4)])
def test_no_number_of_first_turns_drops_a_link(spark, monkeypatch, search):
    """Pairs that only meet in a later group of either are linked as well: the result doesn't hang on the number of turns."""
    monkeypatch.setattr(setlinks, "BLOCK", 16)
    monkeypatch.setattr(setlinks, "TURNS", 0)
    texts = variants(120, 4, words=220, seed=9) + variants(60, 4, words=220, seed=10)
    part = list(range(len(texts)))
    for i, j, _ in sorted(links_of(texts)):
        a, b = part[i], part[j]
        part = [min(a, b) if p in (a, b) else p for p in part]
    got = {r.doc_id: r.component_id for r in search(frame(spark, list(enumerate(texts)))).collect()}
    assert len(set(part)) == 29 and [got[i] for i in range(len(texts))] == part


def test_three_rounds_are_confirmed(spark, monkeypatch):
    """What rests have in later groups and what small groups leave apart is one round: each costs shuffles, however small."""
    monkeypatch.setattr(setlinks, "BLOCK", 16)
    monkeypatch.setattr(setlinks, "TURNS", 0)
    confirm, calls = setlinks.Links.confirm, []
    monkeypatch.setattr(setlinks.Links, "confirm", lambda self, pairs: (calls.append(1), confirm(self, pairs))[1])
    minhash.near_copies(frame(spark, list(enumerate(variants(120, 4, words=220, seed=9)))), shingle=4)
    assert len(calls) == 3


def test_wide_groups_branch_on_and_lists_follow_the_size(spark, monkeypatch):
    """Groups of near misses: with small limits they branch, and the rows listed grow as the texts do."""
    monkeypatch.setattr(setlinks, "WIDE", 64)
    monkeypatch.setattr(setlinks, "FEW", 32)
    listed, sizes = setlinks.Links.listed, []

    def counted(self, members, *args, **kw):
        sizes.append(members.count())
        return listed(self, members, *args, **kw)

    monkeypatch.setattr(setlinks.Links, "listed", counted)
    found = []
    for n in (300, 600):
        sizes.clear()
        texts = variants(n, 14, seed=n) + variants(40, 2, seed=1)
        got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(frame(spark, list(enumerate(texts))), shingle=4).collect()}
        assert all(got[i] == i for i in range(n)) and {got[n + i] for i in range(40)} == {n}
        found.append(max(sizes))
    assert found[1] < 2.5 * found[0]


def test_near_duplicates_of_nothing_and_repeated_rows(spark):
    assert chosen_path.near_duplicates(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "q r s t u v"), (3, None)])
    assert sorted((r.doc_id, r.text) for r in chosen_path.deduplicated(docs).collect() if r.doc_id) == [(1, "a b c d e f"), (3, None)]
    assert chosen_path.deduplicated(docs).columns == docs.columns


def test_dedup_and_decontamination_judge_rows_alone(spark):
    same, other = "one two three four five six seven", "quite another text that stands alone here"
    docs = frame(spark, [(0, same), (1, same), (1, other), (1, other), (None, same), (None, None), (2, "")]).withColumns({c: F.lit(7) for c in ("doc", "key", "kept", "n", "text_key", "__same_text")})
    left = chosen_path.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("0", same), ("1", other), ("None", None), ("2", "")], key=str)
    bench = spark.createDataFrame([(7, other)], "item_id long, text string")
    for limit in (winnowing.BROADCAST_BYTES, 0):
        left = winnowing.drop_contaminated(docs, bench, broadcast_bytes=limit)
        assert left.columns == docs.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(0, same), (1, same), (None, same), (None, None), (2, "")])
    assert winnowing.drop_contaminated(docs.limit(0), bench).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 60)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(60)}


def brute_mix(texts, source, seed="mix", most=3):
    """(source_size, target, copies) of each row, one after another, without Spark."""
    size = [len((t or "").split()) for _, t in texts]
    names = sorted({source[i] for i, _ in texts}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, (i, _) in zip(size, texts, strict=True) if source[i] == s) for s in names}
    weight, target, left, full = {s: (5, 2, 1)[r % 3] for r, s in enumerate(names)}, {}, sum(size), True
    while full:
        level = left / max(1, sum(weight[s] for s in names if s not in target))
        full = [s for s in names if s not in target and weight[s] * level > most * own[s]]
        for s in full:
            target[s], left = most * own[s], left - most * own[s]
    target |= {s: weight[s] * level for s in names if s not in target}
    copies = [0] * len(texts)
    for s in names:
        rows = [k for k, (i, _) in enumerate(texts) if source[i] == s]
        grade = {k: max(1, size[k].bit_length()) for k in rows}
        low, high = 0.0, 10.0**6
        for _ in range(200):  # the level at which the copies that are due come to the target
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(most, mid * grade[k]) * size[k] for k in rows) < target[s] else (low, mid)
        due = {k: min(most, high * grade[k]) if own[s] else 0 for k in rows}
        rest, odds = target[s], {}
        for k in rows:
            copies[k] = int(due[k] + 1e-9)
            rest -= copies[k] * size[k]
            if due[k] - copies[k] > 1e-9:
                i, t = texts[k]
                h = xxhash.xxh64((t or "").encode(), seed=42).intdigest()
                h -= (h >> 63) << 64
                u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}:{h}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                p = due[k] - copies[k]
                odds[k] = u / (1 - u) / (p / (1 - p))
        until = 0
        for k in sorted(odds, key=odds.get):
            if until + size[k] / 2 <= rest:
                copies[k] += 1
            until += size[k]
    return [(own[source[i]], target[source[i]], c) for (i, _), c in zip(texts, copies, strict=True)]


def test_mixing_matches_one_row_after_another(spark):
    texts = [(i, prose(rng.randint(1, 30) if i % 7 else rng.randint(100, 900))) for i in range(600)] + [(1000, None), (1001, ""), (None, "no id")]
    source = {i: ["a", "b", "c", None, "é"][(i or 0) % 5 if (i or 0) % 3 else 0] for i, _ in texts}
    rows = mixing.copies(frame(spark, texts, source=source)).collect()
    expected = {i: x for (i, _), x in zip(texts, brute_mix(texts, source), strict=True)}
    assert len(rows) == len(texts)
    for r in rows:
        own, target, copies = expected[r.doc_id]
        assert (r.source_size, r.copies) == (own, copies) and r.target == pytest.approx(target) and r.size == len((dict(texts)[r.doc_id] or "").split())
    total = sum(r.size for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-6
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 900
        by_grade = {g: [r.copies for r in own if r.size.bit_length() == g] for g in (3, 5)}
        assert s is None or own[0].target >= 3 * own[0].source_size - 1e-6 or np.mean(by_grade[3]) < np.mean(by_grade[5])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.copies(frame(spark, texts[::-1], source=source)).collect()))


def test_mixing_takes_rows_whatever_their_ids_and_columns(spark):
    texts = [(i % 3, prose(rng.randint(1, 9))) for i in range(90)] + [(5, "same row")] * 4
    source = {i: "ab"[i % 2] for i, _ in texts}
    names = ["copies", "copy", "__copies", "row", "step", "whole", "draw", "source_key", "__id"]
    docs = frame(spark, texts, source=source).drop("copies", "row").withColumns({c: F.lit(1) for c in names})
    mix = mixing.mixed(docs)
    got = Counter((r.doc_id, r.text) for r in mix.collect())
    expected = Counter()
    for r in mixing.measured(docs, "mix", "doc_id", "text", "source").select("row.doc_id", "row.text").distinct().collect():
        expected[(r.doc_id, r.text)] = 0
    for (i, t), x in zip(texts, brute_mix(texts, source), strict=True):
        expected[(i, t)] += x[2]
    assert mix.columns == docs.columns
    assert {k: n for k, n in got.items() if k[0] != 5} == {k: n for k, n in expected.items() if n and k[0] != 5}
    assert got[(5, "same row")] % 4 == 0  # equal rows are taken alike
    assert mixing.copies(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.mixed(frame(spark, [(1, None), (2, "")])).count() == 0


def test_language_id_learns_and_rejects(spark):
    words = {"aa": ["wort", "und", "schon", "nacht"], "bb": ["monde", "eau", "leur", "jour"]}
    texts = [(i, " ".join(rng.choices(words["aa" if i % 2 else "bb"], k=8))) for i in range(300)]
    docs = frame(spark, [*texts, *EDGES, (7, "123 ... 456")], lang={i: "aa" if i % 2 else "bb" for i, _ in texts})
    model = langid.fit(langid.teaching(docs))
    got = langid.predict(docs, model).collect()
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 10 < r.doc_id < 300]
    assert held and all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in held) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id == 7 and r.rejected} == {"und"} and len(got) == docs.count()
    assert langid.predict(frame(spark, EDGES), langid.fit(frame(spark, EDGES))).where("lang_pred <> 'und'").count() == 0
    assert langid.fit(frame(spark, [])).languages == []


def test_packed_segments_round_trip():
    g = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        for high in (1, 2, 300, 50_000, 2**32):
            v = g.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            v[::50] = 2**32 - 1
            s = packed.Segment(packed.pack(v, np.array([n])))
            assert (s.ids() == v).all() and (s.ids(7, 300) == v[7:300]).all()


def test_token_files_hold_what_the_tokenizer_gives(spark):
    texts = [*EDGES[:5], (8, "don't  stop\nnow \n x"), (9, "tab\there <|endoftext|> é"), (9, "again"), *((i, prose(50)) for i in range(20, 60))]
    docs = frame(spark, texts)
    path = new_path(spark, "tokens")
    packed.write_tokens(docs, path, queries.tokenizer_path(), end_id=2)
    tokenizer, start, expected = packed.tokenizer_at(queries.tokenizer_path()), 0, []
    for i, t in sorted(texts, key=lambda x: (x[0], x[1] or "")):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in packed.read_tokens(spark, path).collect()) == expected


def jaccard(a, b, k=minhash.SHINGLE):
    """Of the sets of word shingles; empty ones are alike."""
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("name", [lambda i: i * 700, lambda i: 2**60 if i == 30 else i, lambda i: f"id-{i:03d}"])
def test_edited_fingerprints(spark, name):
    texts = sorted([(name(i), prose(rng.randint(0, 60)) if i % 6 else "same words every time in each of these") for i in range(2, 42)] + [(name(0), None), (name(1), "é" * 9)])
    docs = spark.createDataFrame(texts, f"doc_id {'string' if isinstance(name(0), str) else 'long'}, text string").withColumn("part", F.lit(1)).withColumn("head", F.lit(2))
    rows = {r.doc_id: r for r in minhash.with_edited(docs).collect()}
    maker, far = minhash.Fingerprinter(), []
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        t, after, r = t or "", after or "", rows[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (bytes(r.screen).hex(), bytes(r.edited_screen).hex()) == (minhash.hexed(maker.of(t)), minhash.hexed(maker.of(edited)))
        far += [r.near_next - jaccard(t, after), r.near_edited - jaccard(t, edited)]
    assert np.abs(far).max() < 0.3 and np.abs(far).mean() < 0.06  # estimates from 64 minima


def test_edited_fingerprints_of_few_rows_and_repeated_ones(spark):
    assert minhash.with_edited(frame(spark, [])).count() == 0
    assert minhash.with_edited(frame(spark, [(5, "a b c d e f g h")])).first().near_next == 1.0
    rows = minhash.with_edited(frame(spark, [(1, "a b"), (1, "a b"), (None, "c d"), (2, None)])).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == ["1", "1", "2", "None"]
    assert [r.edited_sha256 for r in rows if r.doc_id is None] == [hashlib.sha256(b"c a").hexdigest()]


def test_pseudonyms_keep_formats_and_links(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"]
    docs = frame(spark, [(1, f"{cards[0]} x {cards[1]}"), (2, f"{cards[0]}, {cards[2]} and 4111111111111112"), (3, "2020-02-29 31/12/1999 2021-02-30"), (4, "10.0.0.1 999.1.1.1 123-45-6789 000-12-3456 +1 (377) 555-0123"), (5, "a.b@x.org"), (6, None), (7, "")])
    rows = {r.doc_id: r for r in pii.pseudonymised(docs, key="k").collect()}
    first, second = rows[1].text.split(" x "), rows[2].text
    assert first[0] in second and first[0] == first[1].replace(" ", "") != cards[0] and "4111111111111112" in second

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])

    assert luhn(first[0]) % 10 == 0 and (rows[2].n_card, rows[3].n_date, rows[4].n_ip, rows[4].n_ssn, rows[4].n_phone, rows[5].n_email) == (2, 2, 1, 1, 1, 1)
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d/\d\d/\d{4} 2021-02-30", rows[3].text) and rows[6].text is None and rows[7].text == ""
    pairs = spark.range(0, 70).select(pii.permuted(F.floor(F.col("id") / 10), F.col("id") % 10, F.lit(7), F.lit(10), "k", "t").alias("p")).distinct()
    assert pairs.count() == 70


def test_warc_round_trip(spark):
    html = {1: "<p>é</p>", 2: "<p>é</p>", 3: None, 4: "", 5: "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", 6: "<p>é</p>"}
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i != 2 else None, h, 9) for i, h in html.items()], "page_id long, url string, html string, bytes long")
    path = new_path(spark, "warc")
    warc.write_captures(pages, path)
    got = {int(r.metadata["pageId"]): r for r in warc.resolved(warc.transactions(warc.read_records(spark, path))).collect()}
    for i, h in html.items():
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        same = max(j for j, x in html.items() if (x or "") == (h or ""))
        r = got[i]
        assert r.capture.payload_digest == digest and r.capture.type == ("response" if same == i else "revisit") and r.request is not None
        assert r.metadata["payloadBytes"] == str(len((h or "").encode())) and (r.original["pageId"] if r.original else str(i)) == str(same)
        assert bytes(r.capture.payload) == ((h or "").encode() if same == i else b"")
    empty = new_path(spark, "warc")
    warc.write_captures(pages.limit(0), empty)
    assert warc.transactions(warc.read_records(spark, empty)).count() == 0


@pytest.mark.parametrize("limit", [winnowing.BROADCAST_BYTES, 0])
def test_decontamination_matches_all_windows(spark, limit):
    r = random.Random(4)
    items = [(i, prose(r.randint(13, 40), r)) for i in range(12)] + [(20, "Short item é"), (21, None), (22, "..."), (3, prose(20, r)), (23, prose(30, r))]
    texts = [(i, t) for i, t in EDGES if i is not None]
    for i in range(60):
        w = prose(r.randint(0, 120), r).split()
        if i % 2:
            own = (r.choice(items)[1] or "x").split()
            w[len(w) // 2 : len(w) // 2] = own[r.randint(0, 5) :][: r.randint(8, 40)]
        texts.append((100 + i, ", ".join(w)))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = set()
    for d, t in texts:
        w, hit, seen = words(t), set(), set()
        for i, x in items:
            iw = words(x)
            for k in range(max(0, len(iw) - 12) if len(iw) >= 13 else bool(iw)):
                win = iw[k : k + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        seen.add(str(i))
        expected.add((d, len(w), len(hit), len(seen), winnowing.digest_of(list(seen)), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x) for x in winnowing.contamination(frame(spark, texts), bench, broadcast_bytes=limit).collect()} == expected
    assert winnowing.contamination(frame(spark, texts), bench.limit(0), broadcast_bytes=limit).where("contaminated").count() == 0
    assert winnowing.drop_contaminated(frame(spark, texts), bench).count() == sum(not x[-1] for x in expected)


def test_class_model_scores(spark):
    texts = [(i, prose(20)) for i in range(200)] + EDGES + [(2, "one")]
    docs = frame(spark, texts)
    model, rare = classlm.fit(classlm.teaching(docs).select("text"))
    counts = Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([w.encode() for w in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()] + [None])
    n, v = sum(counts.values()), len(counts)
    rows = classlm.score(docs, model, rare).collect()
    assert len(rows) == len(texts) and model.tokens == n
    by_id = dict(texts)
    for r in rows:
        if r.doc_id is not None and r.doc_id > 10:
            tokens = [w.encode() for w in re.sub("[A-Z]", lambda m: m[0].lower(), by_id[r.doc_id]).split()] + [None]
            assert r.n_tokens == len(tokens) and r.n_known == sum(counts[t] > 0 for t in tokens) and r.score < 0
            assert r.base_score == pytest.approx(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
    model, rare = classlm.fit(frame(spark, []).select("text"))
    assert classlm.score(docs, model, rare).where("n_known > 0").count() == 0


def test_class_model_exchanges_words_beyond_a_fixed_head(spark):
    """Two kinds of rare words of one shape, told apart by their neighbours only, behind more frequent ones than were exchanged."""
    r, texts = random.Random(6), []
    texts += [" ".join(f"h{i:04d}" for i in r.sample(range(2300), 2300)) for _ in range(9)]
    kinds = [[f"{'qz'[k]}{i:04d}" for i in range(60)] for k in (0, 1)]
    for _ in range(8):
        for k, words in enumerate(kinds):
            texts += [f"{'left over'.split()[k]}{r.randrange(2)} {w} {'this that'.split()[k]}{r.randrange(2)}" for w in words]
    model, _ = classlm.fit(frame(spark, list(enumerate(texts))).select("text"))
    place = lambda w: int(model.place.of(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64).view(np.int64))[0])
    found = [Counter(int(model.class_of[place(w)]) for w in words) for words in kinds]
    assert model.exchanged == 2300 + 120 + 8 and all(c < model.learnt for f in found for c in f)
    assert sum((found[0] & found[1]).values()) <= 6
    assert classlm.classes_for(200_000) > classlm.classes_for(20_000) > classlm.CLASSES and classlm.least_count(10**6) < classlm.least_count(10**9)


def test_fingerprints_query_links_near_copies(spark):
    texts = families()
    path = new_path(spark, "fingerprints")
    frame(spark, texts).write.parquet(f"{path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op6_fingerprints(spark, path).collect()}
    expected = {r.doc_id: r for r in minhash.with_edited(frame(spark, texts)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == brute_components(texts, minhash.SHINGLE, 80)
    assert all(r.kept == (r.component_id == i) for i, r in rows.items())
    for i, r in expected.items():
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (bytes(r.screen).hex(), bytes(r.edited_screen).hex())
        assert all(rows[i][c] == r[c] for c in ("n_chars", "edited_sha256", "near_edited", "near_next"))


def test_pseudonyms_of_date_times_and_month_first_dates(spark):
    docs = frame(spark, [(1, "1980-05-01T12:00:00Z 1980-05-01"), (2, "12/25/1980"), (3, "13/13/1980 1980-13-01T12:00 1980-05-01Tx 1980-05-01-2"), (4, "25/12/1980")])
    rows = {r.doc_id: r for r in pii.pseudonymised(docs, key="k").collect()}
    first, second = rows[1].text.split()
    assert first == second + "T12:00:00Z" and second != "1980-05-01" and [rows[i].n_date for i in (1, 2, 3, 4)] == [2, 1, 0, 1]
    (m, d, y), (d4, m4, y4) = rows[2].text.split("/"), rows[4].text.split("/")
    assert (d, m, y) == (d4, m4, y4) and int(m) <= 12 and rows[2].text != "12/25/1980"
    assert rows[3].text == "13/13/1980 1980-13-01T12:00 1980-05-01Tx 1980-05-01-2"


def test_language_id_rejects_a_language_that_it_did_not_learn(spark):
    r = random.Random(12)
    alphabet = {"aa": "eintrsdhul", "bb": "aoqécuèmpg", "cc": "kwyzjvxbfå"}
    lexicon = {lang: ["".join(r.choices(letters, k=r.randint(3, 7))) for _ in range(60)] for lang, letters in alphabet.items()}
    lang = {i: ["aa", "bb", "cc"][i % 3] for i in range(900)}
    docs = frame(spark, [(i, " ".join(r.choices(lexicon[x], k=12))) for i, x in lang.items()], lang=lang)
    model = langid.fit(langid.teaching(docs).where("lang <> 'cc'"))
    got = {(x.lang, x.rejected): x.n for x in langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "rejected").agg(F.count("*").alias("n")).collect()}
    assert got.get(("cc", True), 0) >= 270 and all(got.get((x, False), 0) >= 290 for x in ("aa", "bb"))
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(n for (_, rejected), n in got.items() if not rejected)
    assert langid.keep_known(frame(spark, []), model).count() == 0
    flat = langid.Counts(np.array([0, 2, 2, 3]), np.array([4, 5, 6], np.int16), np.array([0.5, 0.5, 1], np.float32))
    assert [x.tolist() for x in flat.some(np.array([2, 0]))] == [[0, 1, 1], [6, 4, 5], [1, 0.5, 0.5]] and len(flat) == 3


def test_a_join_on_nodes_is_given_few_rows_of_others(spark):
    """Sets and screens of nodes that a round doesn't need are left out where they are; no needed one is, repeated or not."""
    rows = spark.range(20_000).select(F.xxhash64("id").alias("node"), F.col("id").alias("items"))
    wanted = rows.where("items % 1000 = 7").select("node").union(rows.where("items = 7").select("node"))
    links = object.__new__(setlinks.Links)
    got = [r["items"] for r in links.only(rows, wanted).collect()]
    assert {i for i in got if i % 1000 == 7} == set(range(7, 20_000, 1000)) and len(got) == len(set(got)) < 40
    assert links.only(rows, wanted).columns == rows.columns and links.only(rows, wanted.limit(0)).isEmpty()
