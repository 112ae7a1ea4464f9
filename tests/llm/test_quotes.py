import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sparkrecon.llm import quotes, registry


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_pos", F.lit(0)).withColumn("hash", F.lit(0)).withColumn("POSITION", F.lit(-1))
    got = quotes.link(df)
    assert got.columns == ["conv_id", "turn", "role", "text", "_pos", "hash", "position", "reply_to", "n_quotes", "n_linked"]
    return {(r.conv_id, r.position): (r.reply_to, r.n_quotes, r.n_linked, r.text) for r in got.collect()}


def test_replies_follow_quotations(spark):
    rows = [
        (1, 0, "user", "How does a shuffle work?\nAnd what is a spill?"),
        (1, 1, "assistant", "It moves rows between tasks."),
        (1, 2, "user", "On Monday, Ann wrote:\n> How does a  SHUFFLE work?\n> And what is a spill?\n\nI ask again."),
        (1, 3, "assistant", ">> And what is a spill?\n> I ask again.\nSee the guide."),
        (1, 4, "user", "> never said here\nthank you"),
        (2, 0, "user", "> How does a shuffle work?\nin another conversation"),
    ]
    assert run(spark, rows) == {
        (1, 1): (None, 0, 0, rows[0][3]),
        (1, 2): (1, 0, 0, rows[1][3]),
        (1, 3): (1, 3, 3, "I ask again."),
        (1, 4): (3, 2, 2, "See the guide."),
        (1, 5): (4, 1, 0, "thank you"),
        (2, 1): (None, 1, 0, "in another conversation"),
    }


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "u", ""), (3, 1, "u", "a b"), (3, 1, "u", "a b"), (3, None, None, "> > a b\n" + "> a b\n" * 3000), (3, 0, "u", ">>>"), (4, 1, "u", "x" * 100000)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert got[None, 2][0] == 1 and got[3, 4][0] == 2 and got[3, 4][3] == "" and got[3, 1][3] == ""
    assert run(spark, []) == {}


def test_query(spark, sf):
    got = registry.op9_quotation_links(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/conversations.parquet").count()
    assert all(r.reply_to is None if r.position == 1 else r.reply_to < r.position for r in got)


SPACE = "\x20\x09-\x0D"


def brute(rows):
    """Each message of each conversation by the rules, one after the other."""
    normal = lambda x: re.sub(f"[{SPACE}]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    conversations, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        conversations[conv].append((turn is None, turn or 0, role is not None, role or "", text is not None, text or "", text))
    for conv, messages in conversations.items():
        first, parsed = {}, []
        for pos, m in enumerate(sorted(messages, key=lambda m: m[:6]), 1):
            lines = []
            for x in (m[6] or "").split("\n"):
                mark = re.match(r"(?:[ \t]?>)+", x)
                lines.append((mark[0].count(">") if mark else 0, x[mark.end() :] if mark else x))
            lines = [x for i, x in enumerate(lines) if not (re.search(quotes.ANNOUNCES, x[1]) and i + 1 < len(lines) and lines[i + 1][0] > x[0])]
            units = dict.fromkeys(lines)
            for same in (lambda a, b: a[0] == b[0], lambda a, b: a[0] == b[0] and bool(re.search(f"[^{SPACE}]", a[1])) == bool(re.search(f"[^{SPACE}]", b[1]))):
                run = []
                for x in [*lines, None]:
                    if run and (x is None or not same(run[-1], x)):
                        units[run[0][0], "\n".join(y for _, y in run)] = None
                        run = []
                    run.append(x)
            units = [(level, normal(x)) for level, x in units if normal(x)]
            for level, x in units:
                if level == 0:
                    first.setdefault(x, pos)
            parsed.append((pos, m[6], lines, units))
        for pos, text, lines, units in parsed:
            words, n, linked = defaultdict(int), 0, 0
            for level, x in units:
                if level:
                    n += 1
                    if first.get(x, pos) < pos:
                        linked += 1
                        words[first[x]] += len(x.split()) if level == 1 else 0
            best = max(((w, o) for o, w in words.items() if w), default=(0, pos - 1))[1]
            if text is not None and any(level for level, _ in lines):
                text = re.sub(rf"\A[{SPACE}]*\n|[{SPACE}]+\Z", "", "\n".join(x for level, x in lines if not level))
            out[conv, pos] = (best if pos > 1 else None, n, linked, text)
    return out


def test_random_nested_mail(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randrange(1, 9)):
            lines = []
            for _ in range(rng.randrange(0, 4)):
                if said and rng.random() < 0.6:
                    quoted = rng.choice(said).split("\n")
                    at = rng.randrange(len(quoted))
                    mark = rng.choice(["> ", ">", ">> ", "> > "])
                    lines += ["On Monday, Ann wrote:"] * (rng.random() < 0.3)
                    lines += [mark + (x.upper() if rng.random() < 0.2 else x) for x in quoted[at : at + rng.randrange(1, 4)]]
                else:
                    lines += [" ".join(rng.choice("ab cd ef gh 12".split()) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 3))] + [""] * rng.randrange(0, 2)
            said.append("\n".join(lines))
            rows.append((conv, turn, rng.choice("ua"), said[-1]))
    assert run(spark, rows) == brute(rows)
