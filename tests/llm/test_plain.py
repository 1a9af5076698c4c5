"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanforge.llm import codec, decontaminate, exact_dedup, language, lm, packing, pii, quality, simhash, substring_dedup, token_output
from spanforge.llm.graph import components
from spanforge.llm.tokens import Encoder, public_file

WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa Élan naïve 12 x".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(seed=0):
    """Rows with every awkward case."""
    rng = random.Random(seed)
    shared = sentence(rng, 45)
    rows = [(i, sentence(rng, rng.randint(1, 60))) for i in range(40)]
    rows += [(100 + i, f"{sentence(rng, 5)} {shared} {sentence(rng, 3)}") for i in range(4)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, shared), (204, shared), (203, shared), (205, sentence(rng, 4000)), (206, "x"), (207, shared + " " + shared)]
    return rows


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- exact -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.char_length(c).cast("string")], ids=["sha256", "weak"])
def test_exact(docs, digest):
    rows = [*awkward(), (None, "x"), (None, None)]
    got = exact_dedup.exact_dedup(docs(rows).withColumn("_digest", F.lit(1)).withColumn("kept", F.lit(1)), digest=digest).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = Counter()
    for ids in groups.values():
        top = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            want[(i, top, len(ids), i == top and not done)] += 1
            done |= i == top
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_exact_stage(docs):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (5, "b")]
    out = exact_dedup.keep_distinct(docs(rows).withColumn("__digest", F.lit("c")))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "a"), (4, ""), (5, "b")]
    assert "__digest" in out.columns
    assert exact_dedup.keep_distinct(docs([])).count() == 0


# --- simhash -----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(docs):
    rows = [(i, t) for i, t in awkward() if i != 205] + [(300, "A B c d e f"), (301, "a b C d e f")]
    got = by_id(simhash.simhash_groups(docs(rows)))
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == groups_of(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert simhash.simhash_groups(docs([])).count() == 0


def test_masks_cover_every_pair():
    rng = random.Random(1)
    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15 and all(20 <= m.bit_count() <= 44 for m in masks)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not d & m for m in masks)


def test_large_buckets_are_split(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        f = centre
        for b in rng.sample(range(64), rng.randint(1, 5)):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s, s) for s in signed], "node long, fp long")
    label = {r.node: r.label for r in components(simhash.links(df, 3, bucket_rows=16)).collect()}
    want = groups_of(list(range(400)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    classes = defaultdict(set)
    for i, s in enumerate(signed):
        classes[want[i]].add(label.get(s, s))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


# --- substring ---------------------------------------------------------------------------------------


def plain_removal(rows, k):
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - k + 1):
            first.setdefault(tuple(texts[i][s : s + k]), (i, s))
    out = {}
    for i, words in texts.items():
        gone = set()
        for s in range(len(words) - k + 1):
            if first[tuple(words[s : s + k])] != (i, s):
                gone |= set(range(s, s + k))
        out[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_substring(docs, window):
    rows = dict(awkward()).items()
    got = by_id(substring_dedup.substring_dedup(docs(rows).withColumn("starts", F.lit(0)), window))
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in got.items()} == plain_removal(rows, window)
    assert substring_dedup.substring_dedup(docs([])).count() == 0


def test_substring_rows_that_repeat_an_id(docs):
    text = sentence(random.Random(3), 30)
    got = substring_dedup.substring_dedup(docs([(1, text), (1, text), (2, text), (None, text)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 1, 30), (False, 1, 30), (False, 2, 30), (True, 0, 0)]


def test_longest_repeats(docs):
    base = sentence(random.Random(4), 100)
    got = by_id(substring_dedup.longest_repeats(docs([(1, base), (2, base + " end"), (3, " ".join(base.split()[:25])), (4, "other")]), 20))
    assert {i: r.longest for i, r in got.items()} == {1: 80, 2: 80, 3: 20}


# --- contamination -----------------------------------------------------------------------------------


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_hits(rows, items):
    words = plain_words
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, s in items:
            v = words(s)
            n = min(len(v), 8)
            grams = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_contamination(spark, docs, few):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randint(9, 30))) for i in range(12)] + [(50, "Short, item here"), (51, "one"), (52, ""), (53, None), (54, "..."), (2, "a second text of this item with nine words")]
    rows = [(i, t) for i, t in awkward() if i != 203]
    rows += [(400 + i, f"{sentence(rng, 6)}, {t.upper() if i % 2 else t}; {sentence(rng, 4)}") for i, (_, t) in enumerate(items[:12])] + [(450, "a SHORT item, here"), (451, "x one y")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    limits = {} if few else {"broadcast_seeds": 0, "broadcast_positions": 0}
    got = by_id(decontaminate.contamination(docs(rows).withColumn("seed", F.lit(1)), table, **limits))
    assert {i: (r.n_words, r.n_hit, list(r["items"])) for i, r in got.items()} == plain_hits(rows, items)
    assert decontaminate.contamination(docs([]), table).count() == 0
    none = decontaminate.contamination(docs(rows), table.limit(0)).filter("n_hit > 0")
    assert none.count() == 0


# --- personal data -----------------------------------------------------------------------------------

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans(docs):
    rng = random.Random(6)
    parts = ["a@b.c", "a@b.c_d@e.f", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.02.03.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111111111", "5", "12 34",
             "+1 (555) 010-2030", "+12", "+1--------2", "é𝑎", "@", ".", "-", " ", "\n", "%+", "0", "4111111111111111"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(300)]
    rows += [(1000, None), (1001, "1" * 30_000), (1002, "1 " * 20_000), (1003, "a." * 20_000 + "@"), (1004, "a@" + "b." * 9000 + "c"), (1005, "1." * 20_000)]
    got = by_id(pii.pii_spans(docs(rows)))
    for i, t in rows:
        assert [tuple(s) for s in got[i].base] == plain_spans(t), (i, t[:80] if t else t)
    assert pii.pii_spans(docs([])).count() == 0


def test_context_discovers(docs):
    rows = [(i, f"note {i} please write to user{i}@mail.example.com soon") for i in range(8)]
    rows += [(50, "and please write to someone(at)mail77 soon"), (51, "the code someone(at)mail88 is plain"), (52, "please write to")]
    got = by_id(pii.pii_spans(docs(rows), min_seeds=5))
    assert [(s.kind, rows[8][1][s.start : s.end]) for s in got[50].spans] == [("email", "someone(at)mail77")]
    assert got[51].spans == [] and got[52].spans == [] and len(got[3].spans) == 1


def test_discovered_instances_are_seeds(docs):
    rows = [(i, f"note {i} please write to user{i}@mail.example.com soon") for i in range(20)]
    rows += [(30 + i, f"or else reach me other{i}@mail.example.com then") for i in range(4)]
    rows += [(50, "and please write to someone(at)mail77 soon"), (51, "or else reach me someone(at)mail77 then"), (52, "or else reach me nobody(at)mail88 then")]
    got = by_id(pii.pii_spans(docs(rows), min_seeds=5))
    for i in (50, 51, 52):
        text = dict(rows)[i]
        assert [(s.kind, text[s.start : s.end]) for s in got[i].spans] == [("email", text.split()[-2])], i
    assert got[52].spans and not by_id(pii.pii_spans(docs(rows), rounds=1))[52].spans


def test_candidates_of_unseen_forms(docs):
    long = "user" + "x1" * 40 + "-at-mail"
    new = {"phone": ["020 7946 0958", "(555) 010 2030"], "card": ["3782 822463 10005"], "email": ["jane(at)example.com", "jane at example dot com", "jane [at] example [dot] com", long]}
    seeds = {"phone": lambda i: f"+44 20 7946 {1000 + i}", "card": lambda i: "4111 1111 1111 1111" if i == 0 else None, "email": lambda i: f"user{i}@mail.example.com"}
    cards = [c for c in (f"4{n:015d}" for n in range(400)) if sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, c))) % 10 == 0][:30]
    seeds["card"] = lambda i: cards[i]
    rows = [(100 * k + i, f"w{i} {kind}: {seeds[kind](i)} end{i}") for k, kind in enumerate(new) for i in range(30)]
    rows += [(2000 + i, f"{seeds['email'](50 + i)} wrote{i}") for i in range(3)]
    want = {}
    for kind, values in new.items():
        for v in values:
            i = 1000 + len(want)
            want[i] = (kind, v)
            rows.append((i, f"z{i} {kind}: {v}"))
    got = by_id(pii.pii_spans(docs(rows)))
    for i, (kind, v) in want.items():
        assert [(s.kind, dict(rows)[i][s.start : s.end].strip("()")) for s in got[i].spans] == [(kind, v.strip("()"))], (i, v, got[i].spans)


def test_patterns_of_first_words_and_of_the_right(docs):
    rows = [(i, f"user{i}@mail.example.com subscribed w{i}") for i in range(30)] + [(50, "someone-mail77 subscribed today"), (51, "mail: x"), (52, "someone-mail88 left")]
    got = by_id(pii.pii_spans(docs(rows)))
    assert [(s.kind, s.start, s.end) for s in got[50].spans] == [("email", 0, 14)] and not got[51].spans and not got[52].spans


def plain_pii(rows, rounds=3, min_seeds=5, min_confidence=0.8):
    """The spans that the method adds, by loops over all mentions: {row number: [(kind, start, end)]}."""
    find = re.compile(pii._CANDIDATE.replace(r"\z", r"\Z"), re.ASCII)
    edges, mentions = set(), []
    for at, (_, text) in enumerate(rows):
        text = text or ""
        base = plain_spans(text)
        found = [(k, s, e) for k, s, e in base]
        for m in find.finditer(text):
            value = re.sub("[^A-Za-z0-9]+\\Z", "", m[0])
            s, e = m.start(), m.start() + len(value)
            if len(value) >= 6 and not any(a < e and b > s for _, a, b in base):
                found.append((None, s, e))
        for kind, s, e in found:
            before, after = text[max(0, s - 48) : s].lower(), text[e : e + 48].lower()
            one, two = re.search(r"(\S+)\s*\Z", before, re.ASCII), re.search(r"(\S+\s+\S+)\s*\Z", before, re.ASCII)
            right = re.search(r"\A[^\w\s]*\s*(\S*\w)", after, re.ASCII)
            words = [("l1", one and one[1]), ("l2", two and re.sub(r"\s+", " ", two[1], flags=re.ASCII)), ("r1", right and right[1])]
            for p in [(side, w) for side, w in words if w]:
                edges.add((p, text[s:e].lower(), kind))
                mentions.append((at, s, e, p, text[s:e].lower(), kind))
    belief = defaultdict(float)
    for _ in range(rounds):
        weighed = defaultdict(list)
        for p, value, kind in edges:
            for of in BASE:
                weighed[p, of].append((value, float(kind == of) if kind else belief[value, of]))
        patterns = {k: sum(b for _, b in v) / len(v) for k, v in weighed.items() if len({x for x, b in v if b >= min_confidence}) >= min_seeds}
        doubt = defaultdict(lambda: 1.0)
        for p, value, kind in edges:
            if kind is None:
                for of in BASE:
                    if (p, of) in patterns:
                        doubt[value, of] *= max(1 - patterns[p, of], 1e-6)
        belief = defaultdict(float, {k: 1 - d for k, d in doubt.items()})
    best = {}
    for at, s, e, p, value, kind in mentions:
        for of in BASE if kind is None else ():
            if patterns.get((p, of), 0) >= min_confidence and belief[value, of] >= min_confidence:
                best[at, s, e] = max(best.get((at, s, e), (0, "")), (patterns[p, of], of))
    out = defaultdict(list)
    for (at, s, e), (_, of) in best.items():
        out[at].append((of, s, e))
    return out


def planted_pii(rng):
    """Texts in which identifiers of known and unseen forms stand after cues, others without; and which strings are planted."""
    cues = {"email": ["write to", "mail:", "reach me at"], "phone": ["call me on", "tel"], "ip": ["host at", "server"]}
    forms = {
        "email": lambda: f"user{rng.randint(0, 9999)}@mail.example.com",
        "phone": lambda: f"+44 20 {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
    }
    hidden = {
        "email": lambda: f"user{rng.randint(0, 9999)} at mail dot example dot com",
        "phone": lambda: f"0{rng.randint(10, 99)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}",
        "ip": lambda: "-".join(str(rng.randint(100, 255)) for _ in range(4)),
    }
    rows, planted = [], set()
    for i in range(400):
        parts = [sentence(rng, rng.randint(2, 9))]
        for _ in range(rng.randint(0, 3)):
            kind = rng.choice(list(cues))
            if rng.random() < 0.25:
                value = hidden[kind]()
                planted.add((i, kind, value))
            else:
                value = forms[kind]()
            parts += [rng.choice(cues[kind]), value, "then", sentence(rng, rng.randint(2, 9))]
        if rng.random() < 0.5:  # like the hidden ones, in places without a cue
            parts += [rng.choice(["order", "part no", "version"]), rng.choice([f"{rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(100, 999)}", f"ab{rng.randint(1000, 99999)}x"]), "of", sentence(rng, 4)]
        rows.append((i, " ".join(parts)))
    return rows, planted


def test_discovery_equals_the_plain_form_and_finds_what_was_planted(docs):
    rows, planted = planted_pii(random.Random(20))
    extra = [(900, None), (901, ""), (None, rows[3][1]), (3, rows[3][1]), (902, "x " * 30_000 + "write to someone(at)mail77 then")]
    rows += extra
    got = pii.pii_spans(docs(rows).withColumns({c: F.lit("x") for c in ("kind", "pattern", "value", "belief", "_base", "spans")})).collect()
    plain = plain_pii(rows)
    want = Counter((i, tuple(sorted([*plain_spans(t), *plain[at]]))) for at, (i, t) in enumerate(rows))
    assert Counter((r.doc_id, tuple(sorted(tuple(s) for s in r.spans))) for r in got) == want
    added = {(i, k, t[s:e]) for at, (i, t) in enumerate(rows[:400]) for k, s, e in plain[at]}
    assert len(planted & added) >= 0.9 * len(planted) and len(planted & added) >= 0.9 * len(added)


# --- tokens, codec, packing --------------------------------------------------------------------------

TRICKY = ["", "a  b", "a\n\nb", "  x", "x ", "it's. don't, x", "\tabc", "a \n b", "naïve. Ünï, x", "12. 3, a.b", "a.. b", "<|endoftext|> hi.", "A,\nB.", "x\xa0y. z", "ΣΑΣ. Σ, σ", "a\x1cb. c", "a\x01b", "é́ x", "…, a.,b", "a,. b"]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_whole(name, spaces):
    own = Encoder(public_file(name), spaces, entries=50)
    rng = random.Random(7)
    for t in [*TRICKY, *(sentence(rng, 40) for _ in range(20)), *("".join(rng.choice("ab .,'\n1é|!") for _ in range(30)) for _ in range(300))]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_many_texts_equal_whole_ones(monkeypatch):
    """Many new words take few calls of the tokenizer; forgetting, and line ends that tell too little, change no id."""
    own = Encoder(public_file("byte_bpe_50k.json"), True, entries=200)
    rng = random.Random(11)
    texts = [*TRICKY, " ", "a ", " b", "\n", "\na", "x;\ny:", "word; wörd! (a.b). it's 12.", *(sentence(rng, 40) for _ in range(20)), *("".join(rng.choice("ab .,;'\n1é|!") for _ in range(30)) for _ in range(300))]
    plain = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for a, b in ((0, 1), (0, 7), (7, 100), (60, len(texts)), (0, len(texts))):
        assert [x.tolist() for x in own.many([t.encode() for t in texts[a:b]])] == plain[a:b]
    monkeypatch.setattr(own.runs, "line_end", np.array([plain[texts.index("a ")][0]]))  # an id that pieces hold
    own.runs.clear()
    assert [x.tolist() for x in own.many([t.encode() for t in texts])] == plain
    fresh, calls = Encoder(public_file("byte_bpe_50k.json"), True), []
    whole = fresh.runs.whole
    monkeypatch.setattr(fresh.runs, "whole", lambda t: calls.append(t) or whole(t))
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(1000)]
    assert fresh.many([" ".join(words).encode()])[0].tolist() == own.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert len(calls) <= len(words) / 20


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_codec_round_trip(block, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(codec, "LANES", 5)  # more blocks than stand side by side
    for ids in ([], [5], [0] * 300, rng.integers(0, 50257, 500), np.repeat(rng.integers(0, 9, 90), 7), [50256] * 65):
        docs = np.array_split(np.array(ids, np.int64), 3)
        head, doc_ids, lengths, back = codec.read_file(codec.write_file([None, -5, 2**40], docs, block, part=3, seq=2, first=11))
        assert lengths.tolist() == [len(d) for d in docs] and back.tolist() == [int(x) for x in ids]
        assert doc_ids == [None, -5, 2**40] and (head.part, head.seq, head.first, head.n_ids) == (3, 2, 11, len(ids))


def test_codec_adapts_and_checks():
    ids = np.tile(np.arange(40) * 1000, 200)
    data = codec.write_file([1], [ids])
    assert len(data) < len(ids) * 2 / 8
    for at in (3, 40, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            codec.read_file(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_codec_beats_the_entropy_of_single_ids():
    rng = random.Random(18)
    vocab = [rng.randrange(50000) for _ in range(400)]
    after = {v: rng.choice(vocab) for v in vocab}
    ids, x = [], vocab[0]
    for _ in range(60_000):
        x = after[x] if rng.random() < 0.6 else rng.choice(vocab)
        ids.append(x)
    counts = np.array(list(Counter(ids).values())) / len(ids)
    single = -(counts * np.log2(counts)).sum()
    bits = 8 * len(codec.write_file([1], [np.array(ids)])) / len(ids)
    assert bits < 0.85 * single and bits < 8 * len(zlib.compress(np.array(ids, "<u2").tobytes(), 9)) / len(ids)


def test_codec_knows_the_frequencies_before_a_block_begins():
    rng = np.random.default_rng(19)
    ids = np.minimum(rng.zipf(1.3, 60_000) * 3, 45_000)  # no order but the frequencies
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    single = -(counts * np.log2(counts)).sum()
    data = codec.write_file([1], [ids], 512)  # blocks too short to learn an alphabet in
    assert np.array_equal(codec.read_file(data)[3], ids) and 8 * len(data) / len(ids) < 1.25 * single


def test_codec_knows_the_weights_before_a_block_begins():
    rng = np.random.default_rng(21)
    after, ids = rng.integers(0, 200, 200), [0]
    for jump, other in zip(rng.random(40_000) < 0.1, rng.integers(0, 200, 40_000), strict=True):
        ids.append(int(other if jump else after[ids[-1]]))
    ids = np.array(ids)
    data = codec.write_file([1], [ids], 256)  # blocks too short to learn weights in
    assert np.array_equal(codec.read_file(data)[3], ids) and 8 * len(data) / len(ids) < 4.4


def test_codec_takes_alphabets_wider_than_its_ranges(monkeypatch):
    monkeypatch.setattr(codec, "_ZERO", 8)
    ids = np.random.default_rng(20).integers(0, 3000, 5000)
    assert codec._Zero(codec.frequencies(np.ones(3000))).wide
    assert np.array_equal(codec.read_file(codec.write_file([1], [ids], 64))[3], ids)


def test_token_output(spark, folder):
    rows = [*awkward(), (None, "no id"), (None, None)]  # ids that repeat, a very long text
    sf = folder(rows)
    spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("x") for c in ("part", "seq", "payload", "hash", "id")}).write.parquet(f"{sf}/clash/documents.parquet")
    got = sorted(token_output.op2_token_output(spark, f"{sf}/clash").collect(), key=lambda r: r.start)
    tok = Encoder(public_file("byte_bpe_50k.json"), True).tokenizer
    encoded = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in encoded)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)


def test_token_output_of_nothing(spark, folder):
    assert token_output.op2_token_output(spark, folder([])).count() == 0


def test_packing(spark, folder):
    rows = [*awkward(), (500, sentence(random.Random(9), 9000))]
    got = packing.op9_packing(spark, folder(rows)).toPandas()
    assert len(got[got.doc_id == 203]) == 2
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert got.sequence_id.nunique() == packing.lower_bound(got.length.to_numpy(), 4096)
    tok = Encoder(public_file("word_bpe_49k.json"), False).tokenizer
    ids = np.array([*tok.encode(rows[-1][1], add_special_tokens=False).ids, 1], "<u4")
    own = got[got.doc_id == 500].sort_values("piece")
    assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 4096].tobytes()) for s in range(0, len(ids), 4096)]


def test_packing_exchanges(spark):
    lengths = [n for _ in range(30) for n in (1366, 1365, 1365)] + [2048] * 40
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, group_sequences=5).toPandas()
    assert len(got) == len(lengths) and got.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= 1.1 * packing.lower_bound(np.array(lengths), 4096)
    assert packing.pack(pieces.limit(0)).count() == 0


def test_bounds():
    assert packing.lower_bound(np.array([], np.int64), 100) == 0
    assert packing.lower_bound(np.array([51] * 5), 100) == 5
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
    rng = np.random.default_rng(10)
    for _ in range(50):
        x = rng.integers(1, 101, 40)
        assert packing.lower_bound(x, 100) <= packing.best_fit_decreasing(x, 100).max() + 1


# --- models ------------------------------------------------------------------------------------------


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_language_model(spark, folder):
    rows = list(dict(awkward()).items())
    got = by_id(lm.op3_lm_score(spark, folder(rows)))
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    learn = [words(t) for i, t in rows if fold(i, 5) != 1]
    c = Counter(w for t in learn for w in t)
    pairs = Counter(p for t in learn for p in zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    discounts = lambda counts: lm.discounts(*[sum(x == k for x in counts) for k in (1, 2, 3, 4)])
    cont = Counter(b for _, b in pairs)
    dp, dw, total = discounts(pairs.values()), discounts(cont.values()), sum(cont.values())
    rest = sum(dw[min(x, 3)] for x in cont.values()) / total
    left, seen = defaultdict(float), Counter()
    for (a, _), k in pairs.items():
        left[a] += dp[min(k, 3)]
        seen[a] += k

    def p(a, w):
        low = (cont[w] - dw[min(cont[w], 3)]) / total + rest / (v + 1)
        return low if not seen[a] else (pairs[a, w] - dp[min(pairs[a, w], 3)] + left[a] * low) / seen[a]

    for i, t in rows:
        ws = words(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 5) == 1, len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, w)) for a, w in zip(["<s>", *ws[:-1]], ws, strict=True)), rel_tol=1e-6)
    assert math.isclose(sum(p("the", w) for w in c) + p("the", "?"), 1, rel_tol=1e-9)


def test_language_model_of_nothing(spark, folder):
    assert lm.op3_lm_score(spark, folder([])).count() == 0


def test_chunks_round_trip():
    rng = np.random.default_rng(11)
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    counts = rng.integers(1, 2**31, len(keys))
    back = lm.unpack_chunk(lm.pack_chunk(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()
    assert (lm._unspread(lm._spread(keys)) == keys).all()


def test_language(spark, folder):
    vocab = {"en": "the of and that with this from have were".split(), "de": "der die und nicht mit ein auch sich werden".split(), "fr": "le la des une avec pour dans était".split()}
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(30)), k) for i, k in enumerate(["en", "de", "fr"] * 40)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!", None), (903, "nichtt werdend", None), (904, "Der UND", None)]
    got = by_id(language.op7_language(spark, folder(rows)))
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].held_out == (fold(5, 3) == 1)


def plain_language(rows):
    """rows: id, text, lang of all documents; (lang, score) of each."""
    tokens = lambda t: [w for w in (x.strip(language._EDGES) for x in t.lower().split()) if w]
    parts = lambda w, n: [w] if n == 0 else [m[i : i + n] for m in [f"\x02{w}\x03" if n > 1 else w] for i in range(len(m) - n + 1)]
    learn = [(t, k) for i, t, k in rows if fold(i if i is not None else "", 3) != 1 and t is not None and k is not None]
    langs = sorted({k for _, k in learn})
    counts = {(k, n): Counter(g for t, l in learn if l == k for w in tokens(t) for g in parts(w, n)) for k in langs for n in range(5)}
    log_p = lambda k, n, g: math.log((counts[k, n][g] + 0.5) / (sum(counts[k, n].values()) + 0.5 * (len(counts[k, n]) + 1)))
    known = {n: set().union(*(counts[k, n] for k in langs)) for n in range(5)} if langs else {}
    out = []
    for _, t, _ in rows:
        if not langs or not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        total = dict.fromkeys(langs, 0.0)
        for w in tokens(t):
            for n in (0, 4, 3, 2, 1):
                found = [g for g in parts(w, n) if g in known[n]]
                if found:
                    for k in langs:
                        total[k] += sum(log_p(k, n, g) for g in found) / max(n, 1)
                    break
        best = max(langs, key=lambda k: total[k])  # the first of equals
        out.append((best, 1 / sum(math.exp(total[k] - total[best]) for k in langs)))
    return out


def test_language_equals_the_plain_form(spark, folder):
    rng = random.Random(19)
    words = {k: ["".join(rng.choice(c) for _ in range(rng.randint(1, 7))) for _ in range(25)] for k, c in {"aa": "abcdé", "bb": "cdefß", "cc": "efgh'"}.items()}
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(1, 12))), k) for i, k in ((i, rng.choice(list(words))) for i in range(150))]
    rows += [(200 + i, " ".join(rng.choice(words["aa"])[::-1] + rng.choice("xyz") for _ in range(4)), None) for i in range(30)]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "12 ?!", "cc"), (303, "zzzz", None), (None, "abc def", "aa"), (None, None, None), (5, rows[5][1], "bb"), (5, rows[5][1], "bb"), (304, " ".join(words["cc"]) * 3000, None)]
    sf = folder(rows)
    spark.read.parquet(f"{sf}/documents.parquet").withColumns({"lang_pred": F.lit("zz"), "score": F.lit(7), "__text": F.lit(1), "share": F.lit(1), "h": F.lit(1)}).write.parquet(f"{sf}/clash/documents.parquet")
    got = language.op7_language(spark, f"{sf}/clash").collect()
    want = plain_language(rows)
    assert len(got) == len(rows)
    key = lambda i, lang, score: (i is None, i or 0, lang, round(score, 9))
    assert sorted(key(r.doc_id, r.lang_pred, r.score) for r in got) == sorted(key(i, *w) for (i, _, _), w in zip(rows, want, strict=True))


def test_language_ties_and_nothing_at_all(spark, folder):
    rows = [(i, "same words here", k) for i in range(12) for k in ("xx", "yy")]
    assert {(r.lang_pred, round(r.score, 9)) for r in language.op7_language(spark, folder(rows)).collect()} == {("xx", 0.5)}


def test_language_of_an_empty_table(spark, folder):
    assert language.op7_language(spark, folder([])).count() == 0


def test_language_of_nothing(spark, folder):
    assert [r.lang_pred for r in language.op7_language(spark, folder([(1, "abc", None)])).collect()] == ["und"]


def test_quality(spark, folder):
    rng = random.Random(13)
    good = lambda: sentence(rng, rng.randint(20, 150)).capitalize() + "."
    bad = lambda: " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in sentence(rng, rng.randint(20, 150)).split())
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(240)] + [(900, None), (901, ""), (902, "x" * 100_000)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(240)] + [(900, None, None), (None, 1, 0), (5, 1, 0)]
    got = by_id(quality.op5_quality(spark, folder(rows, labels)))
    held = [i for i in range(240) if fold(i, 3) == 1]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_without_labels(spark, folder):
    assert [r.score for r in quality.op5_quality(spark, folder([(1, "a")])).collect()] == [0.5]


def test_quality_equals_the_plain_form(spark, docs):
    rng = random.Random(21)
    rows = [*awkward(), *((500 + i, " ".join(w.upper() + "!" for w in sentence(rng, 70).split())) for i in range(30)), (None, "no id"), (None, None)]
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int")
    table = docs(rows).withColumns({c: F.lit("x") for c in ("score", "__text", "x", "label", "_id")})
    model = quality.train(table, labels)
    got = quality.score(table, model, out_col="found").collect()
    p = model.p

    def plain(text):
        x, sizes = quality.passages([(text or "").encode()])
        hidden, weight = [], []
        for row in x:
            h = [math.tanh(sum((row[i] - p["mean"][i]) / p["std"][i] * p["w1"][i][j] for i in range(len(row))) + p["b1"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[j] * p["v"][j][k] for j in range(len(h)))) / (1 + math.exp(-sum(h[j] * p["u"][j][k] for j in range(len(h))))) for k in range(quality.ATTENTION)]
            hidden.append(h)
            weight.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        mean = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(quality.HIDDEN)]
        return 1 / (1 + math.exp(-sum(m * c for m, c in zip(mean, p["c"], strict=True)) - p["d"][0]))

    assert len(got) == len(rows) and {"score", "x", "label", "__text", "_id"} <= set(got[0].asDict())
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for r in got[:25] + [g for g in got if not g.text or (g.doc_id or 0) > 500][:20]:
        assert math.isclose(r.found, plain(r.text), rel_tol=1e-6, abs_tol=1e-9)


def test_quality_of_an_empty_table_and_of_ties(spark, folder, docs):
    assert quality.op5_quality(spark, folder([])).count() == 0
    even = quality.fit(np.zeros((2, quality.N_FEATURES)), np.array([1, 1]), np.array([1.0, 0.0]), epochs=0)
    assert [r.score >= 0.5 for r in quality.score(docs([(1, "a"), (2, None)]), even).collect()] == [True, True]  # 0.5 counts as label 1


def test_bag_gradients():
    rng = np.random.default_rng(14)
    x, sizes, y = rng.normal(size=(9, quality.N_FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    model = quality.fit(x, sizes, y, epochs=2)
    loss = lambda: -np.mean(y * np.log(f := model.forward(x, sizes)["y"]) + (1 - y) * np.log(1 - f))
    f = model.forward(x, sizes)
    grads = model.gradients(f, (f["y"] - y) / 3)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        model.p[k][at] += 1e-5
        up = loss()
        model.p[k][at] -= 2e-5
        down = loss()
        model.p[k][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-7)


# --- the pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, folder):
    import corpus_pipeline as pipeline

    rng = random.Random(15)
    good = lambda n=80: sentence(rng, n).capitalize() + "."
    items = [(i, sentence(rng, 20)) for i in range(6)]
    rows = [(i, " ".join(w.upper() + "!!" for w in sentence(rng, 60).split()) if i % 5 == 0 else good()) for i in range(200)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 200)]
    long = good(400)
    rows += [(300, rows[1][1]), (301, long), (302, long + " x"), (303, f"{good(30)} {items[0][1]} {items[1][1]}"), (304, f"{good(60)} {items[2][1]}"), (305, None), (306, ""), (307, f"{good(60)} single")]
    items += [(90, "single")]  # one short item is no evidence
    sf = folder(rows, labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        kept.append({r.doc_id for r in docs.collect()})
    assert not {i for i in kept[0] if i < 200 and i % 5 == 0} and len({i for i in range(200) if i % 5} - kept[0]) <= 2
    assert kept[1] == {max(i for i in kept[0] if (before[i] or "") == (before[k] or "")) for k in kept[0]}
    sets = {i: plain_shingles(before[i]) for i in kept[1]}
    assert kept[2] == set(groups_of(sets, lambda a, b: alike(sets[a], sets[b])).values())
    hits = plain_hits([(i, before[i]) for i in kept[2]], items)
    assert all(len(plain_words(t)) >= 8 for _, t in items if t != "single")  # a hit of these is a whole window
    assert kept[3] == {i for i in kept[2] if not [x for x in hits[i][2] if x != "90"]}
    assert 303 not in kept[3] and 304 not in kept[3] and 307 in kept[3]
    packed = pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == kept[3]


def plain_shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize(("rounds", "maps", "block"), [(2, 1, 4096), (0, 0, 4096), (0, 2, 5)])
def test_near_stage_finds_planted_copies(spark, docs, monkeypatch, rounds, maps, block):
    import corpus_pipeline as pipeline
    from spanforge.llm import near

    monkeypatch.setattr(near, "STAR_ROUNDS", rounds)  # stars first, or maps at once
    monkeypatch.setattr(near, "MAP_ROUNDS", maps)
    monkeypatch.setattr(near.near_groups, "__defaults__", (*near.near_groups.__defaults__[:-1], block))
    rng = random.Random(27)
    common = sentence(rng, 40)
    rows = [(i, f"{sentence(rng, rng.randint(1, 80))} {common if i % 3 == 0 else ''}") for i in range(80)]
    for i in range(40):  # copies at 0.8 to 0.95 and around: some words of 200 changed
        words = sentence(rng, 200).split()
        rows.append((1000 + i, " ".join(words)))
        for at in rng.sample(range(200), 1 + i % 6):
            words[at] = f"new{i}"
        rows.append((2000 + i, " ".join(words)))
    base = sentence(rng, 150).split()
    for i in range(40):  # one large group, not all pairs of which are near
        words = list(base)
        for at in rng.sample(range(150), 1 + i % 3):
            words[at] = f"own{i}"
        rows.append((3000 + i, " ".join(words)))
    rows += [(5000, ""), (5001, " "), (5002, "a b"), (5003, "A  b"), (5004, "a b c d e f"), (5005, "a b c d e g")]
    sets = {i: plain_shingles(t) for i, t in rows}
    want = groups_of(sets, lambda a, b: alike(sets[a], sets[b]))
    planted = [i for i in range(40) if alike(sets[1000 + i], sets[2000 + i])]
    far = [i for i in planted if (plain_fingerprint(dict(rows)[1000 + i]) ^ plain_fingerprint(dict(rows)[2000 + i])).bit_count() > 3]
    assert len(planted) > 20 and far  # what 3 bits leave
    kept = {r.doc_id for r in pipeline.near_stage(spark, docs(rows), None).collect()}
    assert kept == set(want.values())


def test_near_stage_compares_a_bucket_again_only_if_it_had_more(spark, docs, monkeypatch):
    import corpus_pipeline as pipeline
    from spanforge.llm import near

    seen, plain = [], near._bucket_pairs

    def spied(rows, *more):
        seen.append([(r.node, r.key, len(r.lesser)) for r in rows.select("node", "key", "lesser").collect()])
        return plain(rows, *more)

    monkeypatch.setattr(near, "_bucket_pairs", spied)
    monkeypatch.setattr(near, "COMMON", 0)  # no shingle is known to be common
    rng = random.Random(29)
    passages = [sentence(rng, 12) for _ in range(6)]
    rows = [(i, " ".join([sentence(rng, 20), *rng.sample(passages, 3), sentence(rng, 20)])) for i in range(30)]
    assert pipeline.near_stage(spark, docs(rows), None).count() == 30  # passages in common, no text near another
    assert len(seen) == 1 and seen[0]
    # each row names the lesser keys of its text alone
    assert all(sorted(n for at, _, n in seen[0] if at == node) == list(range(sum(at == node for at, _, _ in seen[0]))) for node in {at for at, _, _ in seen[0]})


def test_near_stage_of_nothing(spark, docs):
    import corpus_pipeline as pipeline

    assert pipeline.near_stage(spark, docs([]), None).count() == 0


def test_near_stage_drops_rows_not_ids(spark, docs):
    import corpus_pipeline as pipeline

    rng = random.Random(28)
    a, b, c, clean = (sentence(rng, 120) for _ in range(4))
    rows = [(1, a), (2, a + " more"), (2, clean), (None, a + " x"), (3, b), (3, b + " y"), (None, c), (None, c + " z")]
    kept = [(r.doc_id, r.text) for r in pipeline.near_stage(spark, docs(rows), None).collect()]
    assert (1, a) in kept and (2, clean) in kept and (2, a + " more") not in kept and (None, a + " x") not in kept
    assert sorted((i is None, i or 0, t.split()[0]) for i, t in kept) == sorted([(False, 1, a.split()[0]), (False, 2, clean.split()[0]), (False, 3, b.split()[0]), (True, 0, c.split()[0])])
