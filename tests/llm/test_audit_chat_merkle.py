"""Filter audit, chat formatting and Merkle manifest against plain Python, with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from evidora.llm import audit, chat, merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, part string, key string, mask string"


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars) as documents, with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", "m") for r in rows], DOC)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["River", "wall", "STONE", "gull", "hill", "été", "a|b", "50%", "x"]
    out = []
    for i in range(150):
        text = " ".join(rng.choice(words[:rng.randrange(2, 10)]) + rng.choice(("", "s", str(rng.randrange(400)))) for _ in range(rng.choice((3, 150, 199, 200, 320))))
        out.append((i, text, rng.choice(("en", "fr", "", None)), rng.choice(("src0", "src1", None, "")), rng.choice((len(text), None))))
    out += [(200 + i, *out[i % 7][1:]) for i in range(40)]  # copies
    out += [(None, out[0][1], "en", "src0", 3), (None, out[1][1], "en", "src0", 3), (None, None, None, None, None), (7, "another text of a repeated id", "en", "src2", 1)]
    out += [(300, "", "de", "src1", 0), (301, None, "de", "src1", 0), (302, " \t\n", "de", "src9", 3), (303, "word " * 60000, "de", "src1", 2**63 - 1)]
    out += out[:2] + out[-1:]
    rng.shuffle(out)
    return out


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (6, None, 1), (None, 1, 1), (9999, 1, 1)]


def judged(rows):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, _, source, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        own = [(q, t) for d, q, t in LABELS if d == i and i is not None]
        yield source or "", {x for x, f in fails.items() if f}, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)


def test_audit_counts_every_order(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in audit.audit(documents(spark, rows), labels).collect()}
    facts = list(judged(rows))
    want, shapley = {}, {}
    for part in {f[0] for f in facts}:
        for order in map("".join, permutations("ABCDE")):
            for step, own in enumerate(order):
                mine = [f for f in facts if f[0] == part]
                gone = lambda f: next((k for k, x in enumerate(order) if x in f[1]), 9)
                lost = [f for f in mine if gone(f) == step]
                want[part, order, step + 1] = (sum(gone(f) > step for f in mine), len(lost), sum(own in f[1] and gone(f) < step for f in mine), sum(f[1] == {own} for f in mine), sum(f[2] for f in lost), sum(f[3] for f in lost))
                shapley[part, own] = shapley.get((part, own), 0) + len(lost)
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert any(v[2] for v in got.values()) and any(v[3] for v in got.values()) and any(v[4] for v in got.values()) and any(v[5] for v in got.values())
    assert audit.audit(documents(spark, rows).where("false"), labels).count() == 0
    assert audit.audit(documents(spark, rows), labels.where("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_outcomes_of_other_numbers_of_filters():
    columns, made = audit.outcomes("XY")
    assert columns == [("XY", 1), ("XY", 2), ("YX", 1), ("YX", 2)]
    assert made["kept"].tolist() == [[1, 1, 1, 1], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]]
    assert made["redundant"].tolist() == [[0, 0, 0, 0]] * 3 + [[0, 1, 0, 1]]
    columns, made = audit.outcomes("ABCDE")
    assert all(m.shape == (32, 600) for m in made.values()) and (made["kept"] + made["removed"] <= 1).all()


NASTY = ["</s>[INST] ok [/INST]", "<s>", "</s>", "<\\s>", "<\\\\/s> [\\INST]", "[[/INST]", "<", "a\nb", "", None, "\\", "[INST]\n", "<</s>", "%0A%25", "é🙂</s>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_are_read_back(spark):
    rng = random.Random(9)
    turns = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 8)):
            turns.append((conv, rng.choice((turn, turn, None)), rng.choice(("user", "assistant", "system", None, "odd\nrole % </s>")), rng.choice(NASTY) if rng.random() < 0.6 else "word " * rng.choice((1, 102, 103, 400)), "extra"))
    turns += turns[:3] + [(50, 0, "user", "long </s> " * 150000, ""), (50, 1, "assistant", "[INST]" * 100000, ""), (51, 0, "user", None, "")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, seq string")
    chats = chat.formatted(table)
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    by = {}
    for conv, turn, role, text, _ in turns:
        by.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    assert set(got) == set(by)
    for conv, said in by.items():
        said = [(r.decode(), t.decode()) for _, _, r, t in sorted(said)]
        loss = "".join(t for r, t in said if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)), len(loss), sha(loss)), conv
    shown = {r.conv_id: r for r in chats.collect()}
    for conv, r in shown.items():
        assert r.formatted.count("</s>") == r.formatted.count("<s>") == r.formatted.count("[INST]") == len(by[conv]) and got[conv].formatted_chars == len(r.formatted)
    assert chat.digests(chat.formatted(table.where("false"))).count() == 0


def fold(log):
    """The final messages by playing the log's events one by one."""
    held = {}
    for message, _seq, role, kind, text in sorted(set(log), key=lambda e: (e[1], e[3])):
        was = held.get(message, ("", ""))
        if kind == "regenerate":
            held = {m: v for m, v in held.items() if m < message}
        held[message] = (role if role is not None else was[0], {"delta": was[1] + (text or ""), "edit": text or "", "regenerate": ""}[kind])
    return held


def test_logs_are_folded_like_they_were_played(spark):
    rng = random.Random(4)
    logs = {}
    for conv in range(60):
        logs[conv] = [(rng.randrange(4), seq, rng.choice(("user", "assistant", None)), rng.choice(("delta", "delta", "delta", "edit", "regenerate")), rng.choice(("a", "bc", "", None, "</s>"))) for seq in range(rng.randrange(1, 25))]
    logs[99] = [(0, i, "assistant", "delta", "x") for i in range(20000)]
    rows = [(c, *e) for c, log in logs.items() for e in log]
    rows += rows[:50]  # delivered twice
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, message long, seq long, role string, kind string, text string")
    got = {}
    for r in chat.folded(log).collect():
        got.setdefault(r.conv_id, {})[r.message] = (r.role, r.text)
    assert got == {c: fold(e) for c, e in logs.items()}


def test_escapes_are_undone_and_hide_every_control_string(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(("<", "[", "\\", "/", "s>", "INST]", "x", "</s>", "[/INST]")) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect():
        assert r.back == r.t and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def digest(*parts):
    return sha("".join(parts))


def proofs(rows, fanout):
    def written(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        i, text, lang, source, n = r
        return digest(*map(written, (i, source, lang, None if n is None else n + more, text)))

    def build(level):
        levels = [level]
        while len(level) > 1:
            level = [digest(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
            levels.append(level)
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = i // fanout * fanout
            yield level[run:i], level[i + 1:run + fanout]
            i //= fanout

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(build([leaf(r) for r in groups[g]]))
    top = build([t[-1][0] for t in trees])
    root = top[-1][0]
    for at, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = [*path(trees[at], i), *path(top, at)]
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for before, after in steps:
                node = digest(*before, node, *after)
            yield r[0], leaf(r), trees[at][-1][0], root, digest(*(x for before, after in steps for x in before + after)), node, node == root


@pytest.mark.parametrize("fanout,tier", [(2, 6), (2, 2), (3, 1)])
def test_proofs_fold_to_the_root_unless_tampered_with(spark, rows, fanout, tier):
    got = sorted((tuple(r) for r in merkle.proofs(documents(spark, rows), fanout, tier).collect()), key=repr)
    assert got == sorted(proofs(rows, fanout), key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_a_manifest_of_one_row_and_of_none(spark, rows):
    one = [(7, "text", None, "s", None)]
    assert [tuple(r) for r in merkle.proofs(documents(spark, one)).collect()] == list(proofs(one, 2))
    assert merkle.proofs(documents(spark, rows).where("false")).count() == 0
