"""Layouts by the kinds of their fields: records with lists under prompt, systems, histories, empty inputs, preferences, and what is said not to be read."""

import json

from streamworks.llm import chat

M = [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}]
A = [{"role": "assistant", "content": "yo"}]
HI, S = "[INST]hi[/INST]<s>yo</s>", "[SYS]s[/SYS]"

CASES = [
    ({"prompt": "hi", "completion": "yo"}, "prompt", HI, []),
    ({"prompt": "[1] hi", "completion": "{x} yo"}, "prompt", "[INST][1] hi[/INST]<s>{x} yo</s>", []),
    ({"prompt": M, "completion": A}, "prompt of messages", S + HI, []),
    ({"prompt": M, "completion": "yo", "id": 3}, "completion of messages", S + HI, ["id"]),
    ({"prompt": M, "response": "yo"}, "answer to messages", S + HI, []),
    ({"prompt": ["hi"], "completion": "yo"}, None, None, ["completion", "prompt"]),
    ({"prompt": {"text": "hi"}, "completion": "yo"}, None, None, ["completion", "prompt"]),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "system": "s"}, "shared", S + HI, []),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "system": ""}, "shared", HI, []),
    ({"messages": M[1:] + A, "system": "s"}, "messages", S + HI, []),
    ({"messages": M[1:] + A, "question": "other", "answer": "other"}, "messages", HI, ["answer", "question"]),
    ({"messages": M[1:] + A, "prompt": "hi"}, "messages", HI, ["prompt"]),
    ({"instruction": "hi", "input": "", "output": "yo"}, "instruction with input", HI, []),
    ({"instruction": "do", "input": "this", "output": "yo"}, "instruction with input", "[INST]do\n\nthis[/INST]<s>yo</s>", []),
    ({"instruction": "hi", "input": "", "output": "yo", "system": "s"}, "instruction with input", S + HI, []),
    ({"instruction": "hi", "output": "yo", "system": "s"}, "instruction with system", S + HI, []),
    ({"instruction": "hi", "input": "", "output": "yo", "history": [["a", "b"], ["c", None]]}, "instruction with input", "[INST]a[/INST]<s>b</s>[INST]c[/INST]<s></s>" + HI, []),
    ({"instruction": "hi", "output": "yo", "history": []}, "instruction", HI, []),
    ({"instruction": "hi", "output": "yo", "history": "text"}, None, None, ["history", "instruction", "output"]),
    ({"question": "hi", "answer": "yo", "source": "web"}, "question", HI, ["source"]),
    ({"query": "hi", "response": "yo"}, "query", HI, []),
    ({"prompt": "hi", "chosen": "yo", "rejected": "no"}, "preferred", HI, ["rejected"]),
    ({"chosen": M + A, "rejected": M + [{"role": "assistant", "content": "no"}]}, "preferred messages", S + HI, ["rejected"]),
    ({"prompt": "hi", "chosen": M[1:] + A, "rejected": M}, "preferred messages", HI, ["prompt", "rejected"]),
    ({"data": {"question": "hi", "answer": "yo"}}, "nested question", HI, []),
    ({"what": "hi"}, None, None, ["what"]),
]


def test_layouts_of_json_records(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, *_) in enumerate(CASES)], "i int, record string")
    got = {g.i: g for g in chat.format_conversations(df).collect()}
    for i, (record, layout, formatted, unread) in enumerate(CASES):
        g = got[i]
        assert (g.layout, g.formatted, sorted(set(g.unread))) == (layout, formatted, unread), record


def test_layouts_of_structs(spark):
    message = "array<struct<role:string,content:string>>"
    kind = f"i int, record struct<prompt:{message},completion:string,instruction:string,input:string,output:string,system:string,history:array<array<string>>,note:string>"
    rows = [
        (0, ([("user", "hi")], "yo", None, None, None, None, None, None)), (1, (None, None, "hi", "", "yo", "s", [["a", "b"]], "n")), (2, (None, "yo", None, None, None, None, None, None)),
        (3, (None, None, "hi", None, "yo", None, None, None)),
    ]
    got = {g.i: (g.layout, g.formatted, g.unread) for g in chat.format_conversations(spark.createDataFrame(rows, kind)).collect()}
    assert got[0] == ("completion of messages", HI, [])
    assert got[1] == ("instruction with input", S + "[INST]a[/INST]<s>b</s>" + HI, ["note"])
    assert got[2] == (None, None, ["completion"]) and got[3] == ("instruction", HI, [])


def test_records_that_are_no_objects(spark):
    df = spark.createDataFrame([("not json",), (None,), ("",), ("[1,2]",), ("{}",)], "record string")
    assert [(g.layout, g.formatted) for g in chat.format_conversations(df).collect()] == [(None, None)] * 5
