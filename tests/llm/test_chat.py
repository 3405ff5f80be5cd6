import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<|", "|>", "<|end|>", "\\", "\\\\s>", "<\\/s>", "<|>", "[INST] [/INST]", " ", "\n", "", "é", "😀", "$1", "<", "|", "["]
SCHEMA = "conv_id long, turn long, role string, text string, part string, message string, seq int"


def text(rng):
    return "".join(rng.choice(CONTROLS) for _ in range(rng.randrange(9)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "end", "a|>b", "|", "<|x"]
    out = [(c, t, rng.choice(roles), rng.choice([None, text(rng), text(rng) + "w" * rng.randrange(3000)]), "x", "y", 1) for c in (1, 2, -7, 10**12, None) for t in rng.sample(range(90), 40)]
    out += [(5, 7 * t, rng.choice(roles), text(rng), None, None, None) for t in range(400)]  # one large conversation
    out += [(6, None, "user", "no turn", "", "", 0), (6, 3, "user", "tie", "", "", 0), (6, 3, "user", "tie", "", "", 0), (6, 3, "assistant", "tie", "", "", 0), (8, 0, "user", "x" * 200_000, "", "", 0)]
    return out


def brute(rows):
    probe = [(-7, 0, "user", chat.PROBE_TEXT), (-7, 1, "assistant", chat.PROBE_TEXT)]
    conv = {}
    for c, t, role, said, *_ in [*rows, *probe]:
        conv.setdefault(c, []).append((t is not None, t or 0, role or "", said or ""))
    out = {}
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        shown = "".join(shown_turn(*t[2:]) for t in turns)
        out[c] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss), len(shown))
    return out


def shown_turn(role, said):
    esc = lambda s: re.sub(r"<(?=s>|/s>|\|)|\[(?=/?INST\])|\|(?=>)", lambda m: m[0] + "\\", s.replace("\\", "\\\\"))
    if role == "user":
        return f"[INST] {esc(said)} [/INST]"
    return f"<s>{esc(said)}</s>" if role == "assistant" else f"<|{esc(role)}|>{esc(said)}<|end|>"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_report(spark, rows):
    keep = [r for r in rows if (r[0], r[1]) not in ((-7, 0), (-7, 1))]
    got = {r[0]: tuple(r[1:]) for r in chat.report(spark.createDataFrame(keep, SCHEMA)).collect()}
    assert got == brute(keep)
    none = chat.report(spark.createDataFrame([], SCHEMA)).collect()
    assert [r.conv_id for r in none] == [-7] and none[0].loss_chars == len(chat.PROBE_TEXT) and none[0].n_turns == 2


def test_whole_and_its_mask(spark, rows):
    parts = chat.render(chat.fold(chat.as_log(spark.createDataFrame(rows, SCHEMA))))
    back = {r.conv_id: r for r in chat.read_back(parts).collect()}
    for r in chat.whole(parts).collect():
        under = "".join(re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.end]) for s in r.loss)
        assert under == back[r.conv_id].loss_text and len(r.formatted) == back[r.conv_id].formatted_chars
        assert r.formatted == "".join(shown_turn(t.role, t.text) for t in back[r.conv_id].turns)


def folded(events):
    """The log rule event by event: what each message says, and what regenerations take back."""
    convs = {}
    for c, seq, m, kind, role, said in sorted(events, key=lambda e: (e[0], e[1])):
        conv = convs.setdefault(c, {})
        if kind == "regenerate":
            for later in [x for x in conv if x > m]:
                del conv[later]
            conv[m] = [role or conv.get(m, [""])[0], ""]
            continue
        one = conv.setdefault(m, ["", ""])
        one[0] = role or one[0]
        one[1] = (said or "") if kind in ("message", "edit") else one[1] + (said or "")
    return {(c, m): tuple(v) for c, conv in convs.items() for m, v in conv.items()}


def test_fold_against_event_by_event(spark):
    rng = random.Random(11)
    events = []
    for c in range(12):
        roles = {}
        for seq in range(rng.choice([5, 60, 300])):
            m = rng.randrange(rng.choice([3, 40, 150]))
            kind = rng.choices(["delta", "edit", "message", "regenerate"], [8, 2, 2, 1])[0]
            roles.setdefault(m, rng.choice(["user", "assistant"]))
            events.append((c, seq, m, kind, roles[m], rng.choice([None, "a", "bc ", "</s>"])))
    rng.shuffle(events)
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == folded(events)
    assert chat.fold(df.where("false")).count() == 0


def test_odd_events(spark):
    events = [
        (1, None, 0, "delta", "user", "before all, "),
        (1, 5, 0, None, None, "an unknown kind"),
        (None, 1, 0, "message", None, None),
        (None, 2, 0, "delta", None, "x"),
        (2, 1, None, "message", "user", "no place"),
        (2, 1, 3, "regenerate", "assistant", None),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {(1, 0): ("user", "before all, an unknown kind"), (None, 0): ("", "x"), (2, None): ("user", "no place"), (2, 3): ("assistant", "")}


def test_a_hot_conversation_meets_as_parts(spark):
    rows = spark.range(20_000).select(F.lit(3).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    parts = chat.render(chat.fold(chat.as_log(rows)))
    assert parts.count() == -(-20_000 // chat.TURNS)
    turns = chat.read_back(parts).first().turns
    assert [t.text for t in turns] == [str(i) for i in range(20_000)]


def test_no_python_in_the_plan(spark, rows):
    plan = chat.report(spark.createDataFrame(rows, SCHEMA).where("true"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
