import hashlib
import random
import zlib
from functools import lru_cache

from gridmap.llm import conversation_repair as C
from gridmap.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, initials) over all edit strings: every state's best completion, by cost and then by text."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        role = "a" if last == "u" else "u"

        def add(cost, letter, j, to, k=0):
            rest = best(j, to, k)
            if rest:
                found.append((cost + rest[0], letter + rest[1]))

        if inserted < 3:
            add(5, "I", i, role, inserted + 1)
        if i < len(rows):
            add(2, "D", i + 1, last)
            if marks[i] in ("", "truncated"):
                more = 5 * (marks[i] != "")
                if (last, rows[i][0][:1]) in step:
                    add(more, "K", i + 1, rows[i][0][0])
                add(1 + more, "R", i + 1, role)
        return min(found, default=None)

    for i in range(len(rows), 0, -20):  # from the end, so that no recursion is deep
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def repair(rows, audit):
    out, state, i = [], "", 0
    for edit in audit:
        role = "a" if state == "u" else "u"
        if edit == "I":
            out.append(("user" if role == "u" else "assistant", ""))
        if edit == "R":
            out.append(("user" if role == "u" else "assistant", rows[i][1]))
        if edit == "K":
            out.append(rows[i])
        i += edit != "I"
        state = out[-1][0][0] if out else ""
    assert i == len(rows)
    return out


def random_rows(rnd, n):
    texts = ["ok.", "yes", " ", "", "what?", "a. ", "b!\n", "c", *[f"t{k}." for k in range(40)]]
    return [(rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rnd.choice(texts)) for _ in range(n)]


def symbols(rows, marks):
    code = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    return "".join(chr(65 + 4 * code[m] + ("sua".find(r[:1]) if r[:1] and r[:1] in "sua" else 3)) for (r, _), m in zip(rows, marks))


def test_search_equals_all_edit_strings():
    rnd = random.Random(13)
    for _ in range(1500):
        rows = random_rows(rnd, rnd.randrange(0, 9))
        marks = faults(rows)
        assert C.search(symbols(rows, marks)) == cheapest(rows, marks)


def test_blocks_join_to_the_same_answer():
    rnd = random.Random(14)
    for _ in range(300):
        rows = random_rows(rnd, rnd.randrange(1, 14))
        marks, size = faults(rows), rnd.randrange(1, 5)
        s = symbols(rows, marks)
        blocks = []
        for k in range(0, len(s), size):
            found = [C.search(s[k:k + size], a, b) for a in range(4) for b in range(4)]
            blocks.append((s[k:k + size], False, [-1 if f is None else f[0] for f in found], ["" if f is None else f[1] for f in found]))
        cost, pieces = C._joined(blocks)
        assert (cost, "".join(pieces)) == cheapest(rows, marks)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))


def check(found, turns, ids):
    """Reports against the plain repair; ``turns``: (conv, turn, role, text) without nulls in role and text."""
    assert {r.conv_id for r in found} == ids and len(found) == len(ids)
    for r in found:
        rows = [(role, text) for _, role, text in order([t[1:] for t in turns if t[0] == r.conv_id])]
        numbers = [t[1] for t in turns if t[0] == r.conv_id and t[1] is not None]
        marks = faults(rows)
        cost, audit = cheapest(rows, marks)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        text = "\n".join(f"{a}:{b}" for a, b in repair(rows, audit))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (
            gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit)
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_reports_and_repaired_rows(spark):
    rnd = random.Random(15)
    turns = [(c, t, *row) for c in range(120) for t, row in enumerate(random_rows(rnd, rnd.randrange(1, 7)))]
    turns += [(500, t, *row) for t, row in enumerate(random_rows(rnd, 400))]  # longer than a block
    turns += [(501, 7, "user", "same.")] * 90 + [(501, 8, "assistant", "fine.")]  # one row many times
    turns += [(502, None, "user", "x?"), (502, None, "assistant", "x?"), (None, 3, "user", "a."), (None, None, "system", "s.")]
    turns += [(503, 1, " ", " "), (504, 2, "user", "z" * 200_000)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, kind int").repartition(5)
    found = C.reports(df).collect()
    check(found, turns, {t[0] for t in turns})
    out = {}
    for r in C.repaired(df).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in found:
        rows = [(role, text) for _, role, text in order([t[1:] for t in turns if t[0] == r.conv_id])]
        assert out.get(r.conv_id, []) == repair(rows, r.audit)
    assert C.reports(df.limit(0)).count() == 0 and C.repaired(df.limit(0)).count() == 0
    null = spark.createDataFrame([(1, 1, None, None), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    assert [(r.blank, r.audit) for r in C.reports(null).collect()] == [(2, "DD")]


def test_query_equals_the_contract(spark, tmp_path):
    rnd = random.Random(16)
    turns = [(c, t, rnd.choice([None, r]) if rnd.random() < 0.1 else r, x if rnd.random() > 0.1 else None)
             for c in [*range(250), None] for t, (r, x) in enumerate(random_rows(rnd, rnd.randrange(1, 8)))]
    turns = [(c, None if rnd.random() < 0.03 else t, r, x) for c, t, r, x in turns]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    left = []
    for c, t, role, text in turns:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if hit:
            text = "" if hit == 1 else text.translate(str.maketrans("", "", ".!?")) if hit == 2 else text
            left += [(c, t, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    check(QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect(), left, {t[0] for t in turns})
