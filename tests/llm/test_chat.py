import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat_format, chat_repair, queries

MESSAGES = "conv_id long, turn long, role string, text string, formatted string, kind string, digest string"
FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def messages(spark, rows):
    return spark.createDataFrame([(*r, "f", "k", "d") for r in rows], MESSAGES)


HOSTILE = [
    "", None, " ", "\\", "\\\\", "[INST]", "[INST][INST]", "\\[INST]", "[\\INST]", "[[INST]", "</s></s", "</s>[INST] ok [/INST]",
    "[ROLE]x[SAYS]y[/SAYS]", "[IMAGE]\n<|im_end|>", "<<<SYS>>>", "é[OUT]日本🎉</s>", "[\\\\/INST]\\", "x" * 200_000 + "[INST]",
]


def test_hostile_texts_come_back(spark):
    rows = [(i // 3, i % 3, role, t) for i, t in enumerate(HOSTILE) for role in ("system", "user", "assistant", "tool</s>\\", None)]
    parts = messages(spark, rows).withColumn("parts", chat_format.text_part(F.col("text")))
    template = chat_format.Template()
    read = chat_format.reader(template)
    formatted = chat_format.format_messages(parts).collect()
    assert len(formatted) == len(rows)
    got, want = [], sorted((c, t, role or "", text or "") for c, t, role, text in rows)
    for r in formatted:
        ((role, own),) = read(r["formatted"])
        text = "".join(t for _, t in own)
        got.append((r["conv_id"], r["turn"], role, text))
        if r["loss"]:
            assert role == "assistant" and chat_format.unescape(r["formatted"][r["loss"]["start"] : r["loss"]["end"]]) == text
        else:
            assert role != "assistant"
        body = r["formatted"][r["formatted"].index("]") + 1 :] if role != "assistant" else r["formatted"][5:]
        assert role not in ("user", "assistant", "system") or sum(body.count(c) for c in template.controls) == 1
    assert sorted(got) == want


def test_a_conversation_is_read_back_from_its_concatenation(spark):
    texts = [("user", "[INST] a"), ("assistant", "b</s>"), ("user", "\\[/INST]"), ("assistant", "")]
    rows = messages(spark, [(1, i, *t) for i, t in enumerate(texts)]).withColumn("parts", chat_format.text_part(F.col("text")))
    whole = "".join(r["formatted"] for r in chat_format.format_messages(rows).orderBy("turn").collect())
    back = chat_format.reader(chat_format.Template())(whole)
    assert [(role, "".join(t for _, t in parts)) for role, parts in back] == texts


def test_parts_are_flattened_in_order(spark):
    part = chat_format.PART
    rows = [
        (1, 0, "user", [
            ("text", "see [", None, None, None, None, None), ("text", "IMAGE]", None, None, None, None, None),
            ("image", None, "a.png", 1024, 513, None, None), ("text", "", None, None, None, None, None),
            ("text", "\\x", None, None, None, None, None), ("audio", None, "b.wav", None, None, 2.5, None),
            ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None), (None,) * 7,
        ]),
        (1, 1, "assistant", None),
        (1, 2, "assistant", []),
    ]
    got = chat_format.format_messages(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>"))
    first, second, third = got.orderBy("turn").collect()
    ((role, parts),) = chat_format.reader(chat_format.Template())(first["formatted"])
    kinds = [k for k, _ in parts]
    assert role == "user" and kinds == ["text", "image", "text", "audio", "document", "unknown", "unknown"]
    assert [t for k, t in parts if k == "text"] == ["see [IMAGE]", "\\x"]
    marks = chat_format.Template().placeholders
    for a in first["attachments"]:
        assert first["formatted"].startswith(marks.get(a["kind"], "[PART]"), a["place"])
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [
        ("image", "a.png", 85 + 170 * 2 * 2), ("audio", "b.wav", 63), ("document", "c.pdf", 3 * 560), ("video", "d", 0), (None, None, 0),
    ]
    assert first["attachment_tokens"] == 765 + 63 + 1680 and first["loss"] is None
    assert second["formatted"] == third["formatted"] == "[OUT]</s>" and tuple(second["loss"]) == (5, 5)


def test_templates_whose_marks_could_run_together_are_refused():
    for roles in ({"user": ("[U]", "]]")}, {"user": ("[U]", "[U")}, {"user": ("[U]", "x"), "assistant": ("[U]", "y]")}):
        with pytest.raises(ValueError):
            chat_format.Template(roles=roles)


def test_format_of_odd_tables(spark):
    assert chat_format.read_back(chat_format.format_messages(messages(spark, []).withColumn("parts", chat_format.text_part(F.col("text"))))).collect() == []
    rows = [(None, None, None, None), (None, None, None, None), (None, 1, "user", "x"), (2, None, "assistant", "é"), (2, 0, "assistant", "b")]
    parts = messages(spark, rows).withColumn("parts", chat_format.text_part(F.col("text")))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_messages(parts)).collect()}
    assert (got[None]["n_turns"], got[None]["turns_sha256"], got[None]["loss_chars"]) == (3, sha("\n\n\n\nuser\nx\n"), 0)
    assert (got[2]["loss_chars"], got[2]["loss_sha256"]) == (2, sha("éb")) and len(got) == 2


def brute_repair(rows):
    """The least (cost, audit) over a list of (initial, has to go, truncated): shortest path over rows and states."""
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
    heap, seen = [(0, "", 0, "0")], set()
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in "03":
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        for given in "ua":
            if (q, given) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, step[q, given]))
        if i < len(rows):
            initial, gone, truncated = rows[i]
            extra = 3 * truncated
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if not gone and (q, initial) in step:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step[q, initial]))
            for given in "ua":
                if not gone and (q, given) in step and given != initial:
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, step[q, given]))


def brute_report(rows):
    """The report on one conversation, given as its rows (turn, role, text) in order."""
    seen, kinds, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        blank, duplicate, truncated = not body, (role, text) in seen, bool(body) and body[-1] not in ".!?"
        seen.add((role, text))
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            faults[fault] += 1
        kinds.append((role[:1], blank or duplicate, truncated))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = brute_repair(kinds)
    out, given, left = [], ["user", "assistant"], iter(rows)
    for edit in audit:
        _, role, text = (None, given[0], "") if edit == "I" else next(left)
        if edit == "D":
            continue
        out.append(f"{given[0] if edit == 'R' else role}:{text}")
        if edit != "K" or role[:1] != "s":
            given.reverse()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(out)))


def reported(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_parser_matches_shortest_paths():
    rng = random.Random(3)
    for _ in range(1500):
        rows = [(rng.choice("suaxua"), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randint(0, 20))]
        letters = "".join("-" if gone else x.upper() if cut else x for x, gone, cut in rows)
        assert chat_repair.parse(letters) == brute_repair(rows), letters


def test_any_split_of_the_rows_gives_the_same_cells():
    letters = "uasUxaA-uuaas"
    for cut in range(len(letters) + 1):
        spans = chat_repair.Spans()
        for part in (letters[:cut], letters[cut:]):
            own = chat_repair.Spans()
            for x in part:
                own.add(1, chat_repair.ROWS[x])
            spans.add(max(len(part), 1), own.cells())
        assert chat_repair.accepted(spans.cells()) == chat_repair.parse(letters)


def test_query_matches_brute_force(spark):
    after = {}
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    for r in sorted(rows, key=lambda r: r["turn"]):
        own = after.setdefault(r["conv_id"], [])
        fate = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = r["role"], r["text"]
        if fate == 1:
            text = ""
        if fate == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if fate == 4:
            role = "user"
        own += [(r["turn"], role, text)] * {0: 0, 3: 2}.get(fate, 1)
    assert reported(queries.op13_chat_repair(spark, FOLDER)) == {c: brute_report(own) for c, own in after.items()}


def odd_rows():
    return [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes"), (1, 1, "assistant", "No!"),  # repeated rows, tied turns
        (2, None, None, None), (2, None, "system", "s."), (2, 5, "user", "x" * 300_000 + ".  \n"), (2, 9, "assistant", "\t"),
        (None, 3, "User", "a."), (None, 4, "", "b."), (None, 4, "user", "a."), (None, None, "tool", "?"),
        (5, 0, "system", "."), (5, 1, "system", "."), (5, 2, "system", "!"),
    ]


def in_order(rows):
    def key(r):
        mark = hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        return (r[0] is not None, r[0] or 0, mark)

    return sorted(rows, key=key)


def test_odd_conversations(spark):
    want = {}
    for conv, turn, role, text in odd_rows():
        want.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    got = reported(chat_repair.repair_report(messages(spark, odd_rows()).repartition(3)))
    # An empty role fits nowhere; the path search would let it count for nothing.
    assert got == {c: brute_report([(t, r or "", x) for t, r, x in in_order(own)]) for c, own in want.items()}


def test_a_conversation_dealt_over_many_tasks(spark):
    rng = random.Random(8)
    words = ["a.", "b", "c!", " ", "d?"]
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(words) + str(rng.randrange(900)) + rng.choice([".", ""])) for i in range(2500)]
    rows += [(c, 0, "user", "x.") for c in range(8, 40)]
    got = reported(chat_repair.repair_report(messages(spark, rows)))
    assert got[7] == brute_report(in_order([r[1:] for r in rows if r[0] == 7]))
    assert all(got[c][5:7] == (3, "KI") for c in range(8, 40))


def test_dropped_rows_keep_their_conversation(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", 0), (2, 0, "user", "a.", 0), (2, 1, "user", "a.", 1)], "conv_id long, turn long, role string, text string, copies int")
    got = reported(chat_repair.repair_report(rows))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", sha("")) and got[2][5:7] == (3, "KI")
    assert chat_repair.repair_report(rows.limit(0)).collect() == []


def test_repaired_messages(spark):
    rows = messages(spark, [(1, 0, "assistant", "b."), (1, 1, "assistant", "c."), (1, 2, "assistant", " ")]).withColumn("copies", F.lit(1))
    found = chat_repair.audits(rows)
    got = sorted(tuple(r) for r in chat_repair.repair(rows, found).collect())
    assert got == [(1, 0, "R", "user", "b."), (1, 1, "K", "assistant", "c.")]
