"""Chat formatting and structure repair: brute force, templates that rewrite history, odd rows, many pieces."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tandem.llm import chat_format, structure
from tandem.llm.chat_queries import TRICKY

SCHEMA = "conv_id long, turn long, role string, text string, part int, piece int, kinds string"


@pytest.fixture
def spread(spark):
    """Small partitions stay as they are, so that a conversation lies in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


ODD = [
    (None, 0, "user", "no id."), (None, 1, "assistant", "None."), (1, None, "user", "null turn"), (1, 3, None, "no role."), (1, 3, "assistant", None), (1, 0, "", "empty role?"),
    (2, 0, "user\nx\\n", "odd <|im_end|> <\\|x <| |> \\"), (2, 1, "assistant", TRICKY), (2, 1, "assistant", TRICKY), (3, 0, "user", ""), (3, 7, "assistant", " \t\n"), (4, 0, "user", "word. " * 200_000), (4, 1, "assistant", "é😀. " * 1000),
    (5, 5, "system", "sys."), (5, 5, "user", "tie."), (5, 5, "assistant", "tie."), (6, 0, "tool", "x."), (7, -3, "assistant", "neg!"), (7, 9, "user", "far?"),
]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = ordered([(r[0], r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        said = "".join(r[3] for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def read_back(spark, rows, **options):
    got = chat_format.read_back(chat_format.format_chats(rows_of(spark, rows), **options)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got}


def test_odd_turns_come_back(spark):
    assert read_back(spark, ODD) == plain_chat(ODD)


def long_talk(n, seed=1):
    rng = random.Random(seed)
    talk = [(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " + "<|im_end|>" * rng.randrange(3)) for k in range(n)]
    return talk + [(k, t, "user" if t % 2 == 0 else "assistant", f"{k} says {t}") for k in range(20, 40) for t in range(rng.randrange(1, 6))]


@pytest.mark.parametrize("piece", [1, 7])
def test_a_conversation_in_pieces_over_partitions(spread, piece):
    rows = long_talk(300)
    out = chat_format.format_chats(rows_of(spread, rows), piece=piece)
    pieces = [(r["part"], r["piece"], r["formatted"]) for r in out.filter("conv_id = 9").collect()]
    text, _, _ = chat_format.spans(chat_format.CHATML.render, [(r[2], r[3]) for r in rows if r[0] == 9])
    assert "".join(p[2] for p in sorted(pieces)) == text and len({p[0] for p in pieces}) > 1
    assert read_back(spread, rows, piece=piece) == plain_chat(rows)


def test_equal_rows_all_count(spark):
    rows = [(1, 0, "user", "again")] * 500 + [(1, 1, "assistant", "yes")]
    assert read_back(spark, rows) == plain_chat(rows)


def test_no_rows(spark):
    none = rows_of(spark, ODD).limit(0)
    assert chat_format.read_back(chat_format.format_chats(none)).collect() == []
    assert structure.summary(structure.repair(structure.damage(none)), none).collect() == []


def templates():
    """Inner functions, which reach the workers by value."""

    def forgets(messages):  # thoughts stay in the last answer alone
        last = max((k for k, (r, _) in enumerate(messages) if r == "assistant"), default=-1)
        return "<s>" + "".join(f"[{r}]{t if k == last or r != 'assistant' else re.sub('<think>.*?</think>', '', t)}[/]" for k, (r, t) in enumerate(messages))

    def numbered(messages):
        return "".join(f"{k}:{r}>{t}\n" for k, (r, t) in enumerate(messages))

    def begins(messages):
        return "<s>" + "".join(f"[{r}]{t}[/]" for r, t in messages)

    return {"forgets": forgets, "numbered": numbered, "begins": begins}


forgets, begins = templates()["forgets"], templates()["begins"]


def test_templates_that_rewrite_history_are_found():
    talk = [("user", "q"), ("assistant", "<think>a</think>b"), ("user", "r"), ("assistant", "c")]
    text, found, rewriting = chat_format.spans(forgets, talk)
    assert rewriting == [3] and text == forgets(talk)
    assert found[0].start == 3 and text[found[0].text_start : found[0].text_end] == "q"
    assert found[1].start is None and found[2].start is None  # both moved
    plain = [("user", "q"), ("assistant", "b"), ("user", "r"), ("assistant", "c")]
    text, found, rewriting = chat_format.spans(forgets, plain)
    assert not rewriting and [text[s.text_start : s.text_end] for s in found] == ["q", "b", "r", "c"]
    assert chat_format.spans(begins, [])[0] == "<s>"


@pytest.mark.parametrize("name", ["numbered", "forgets", "begins"])
def test_templates_that_look_back_are_rendered_whole(spread, name):
    render = templates()[name]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"<think>{k}</think> turn {k}") for k in range(90)] + [(2, 0, "user", "short")]
    template = chat_format.Template(render, lambda t: t, lambda t: [])
    out = chat_format.format_chats(rows_of(spread, rows), template, piece=8).orderBy("part", "piece").collect()
    for conv in (1, 2):
        whole = render([(r[2], r[3]) for r in rows if r[0] == conv])
        assert "".join(r["formatted"] for r in out if r["conv_id"] == conv) == whole
    if name == "forgets":
        assert [x for r in out for x in r["rewriting"]][:3] == [3, 5, 7]


def test_escaping_is_reversible():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("<\\|>ab") for _ in range(rng.randrange(12)))
        assert chat_format.unescape(chat_format.escape(t)) == t and "<|" not in chat_format.escape(t)


COST = {"D": 2, "I": 5, "K": 0, "R": 1}


def brute_edits(kinds):
    """kinds: (initial, to be deleted, truncated). All edit sequences by increasing length, cheapest and least first."""
    best = None

    def go(k, out, letters, cost, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(kinds):
            if re.fullmatch("(s?(ua)+)?", out):
                best = min(best or (99, ""), (cost, letters))
        else:
            i, bad, cut = kinds[k]
            go(k + 1, out, letters + "D", cost + 2, inserted)
            if not bad:
                go(k + 1, out + (i or "?"), letters + "K", cost + 5 * cut, inserted)
                for r in "ua":
                    go(k + 1, out + r, letters + "R", cost + 1 + 5 * cut, inserted)
        if inserted < 2:
            for r in "ua":
                go(k, out + r, letters + "I", cost + 5, inserted + 1)

    go(0, "", "", 0, 0)
    return best


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(250):
        kinds = [(rng.choice(["s", "u", "u", "a", "a", "t", ""]), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(0, 6))]
        coded = [structure.BAD if bad else ("sua".find(i) if i in "sua" and i else 3) + 4 * cut for i, bad, cut in kinds]
        edits, _ = structure.trace(coded, [1] * len(coded), structure.backwards(coded, structure.apart(structure.END)), 0, True)
        letters = "".join(edits)
        cost = sum(COST[x] for x in letters) + sum(5 for e, k in zip(edits, coded) if e[-1:] in ("K", "R") and k >= 4 and k != structure.BAD)
        assert (cost, letters) == brute_edits(kinds), kinds


def test_vectors_forget_their_end_and_reruns_stop_there():
    rng = random.Random(6)
    for _ in range(300):
        kinds = [rng.choice([0, 1, 2, 1, 2, 3, 5, 6, 8]) for _ in range(rng.randrange(1, 30))]
        a, b = (structure.apart(structure.closed(tuple(rng.randrange(20) for _ in range(4)))) for _ in range(2))
        assert structure.rerun(kinds, a, b, structure.backwards(kinds, a)[0]) == structure.backwards(kinds, b)[0]


def plain_repair(rows):
    """The contract, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            rest = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if rest:
                text = "" if rest == 1 else re.sub("[.!?]", "", text) if rest == 2 else text
                own += [(conv, turn, "user" if rest == 4 else role, text)] * (2 if rest == 3 else 1)
        own, seen, kinds, count = ordered(own), set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            stripped = text.rstrip(" \t\n\v\f\r")
            blank, again = not stripped, (role, text) in seen
            cut = not blank and stripped[-1] not in ".!?"
            seen.add((role, text))
            if fault := "blank" if blank else "duplicate" if again else "truncated" if cut else None:
                count[fault] += 1
            kinds.append(structure.BAD if blank or again else ("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3) + 4 * cut)
        edits, _ = structure.trace(kinds, [1] * len(kinds), structure.backwards(kinds, structure.apart(structure.END)), 0, True)
        said, letters = [], "".join(edits)
        for k, e in enumerate(edits):
            for x in e:
                user = not said or said[-1][0][:1] != "u"
                said += [] if x == "D" else [own[k][2:] if x == "K" else ("user" if user else "assistant", "" if x == "I" else own[k][3])]
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in {"su", "ua", "au"} for a, b in itertools.pairwise(own))
        cost = sum(COST[x] for x in letters) + sum(5 for e, k in zip(edits, kinds) if e[-1:] in ("K", "R") and 4 <= k < 8)
        out[conv] = (gaps, *count.values(), illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


def repaired(spark, rows, **options):
    df = rows_of(spark, rows)
    got = structure.summary(structure.repair(structure.damage(df), **options), df).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def test_odd_conversations(spark):
    assert repaired(spark, ODD) == plain_repair(ODD)


def messy(n, conv, rng):
    roles = ["user", "assistant"] * 6 + ["system", "tool", "unknown"]
    return [(conv, None if rng.random() < 0.02 else k + 2 * (k > n // 2), roles[k % 2] if rng.random() < 0.8 else rng.choice(roles), rng.choice(["a.", "b!", f"own {k}.", f"cut {k}", " "])) for k in range(n)]


@pytest.mark.parametrize("piece", [12, 64])
def test_long_conversations_in_pieces(spread, piece):
    rng = random.Random(7)
    rows = messy(400, 1, rng) + [r for c in range(2, 30) for r in messy(rng.randrange(1, 9), c, rng)]
    assert repaired(spread, rows, piece=piece) == plain_repair(rows)


def test_rows_repeated_many_times(spread):
    rows = [(1, 2, "user", "same.")] * 300 + [(1, t, "assistant", "ok.") for t in range(3, 60)] + [(1, None, "user", f"{k}.") for k in range(50)]
    assert repaired(spread, rows, piece=8) == plain_repair(rows)
