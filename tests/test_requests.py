import json
import random

import pytest

from maskwright.functions.jsontext import decoded_strings, extract_json, readable, strings
from maskwright.plans import requests as R
from maskwright.sources import sse
from maskwright.streaming.restore import EventRestorer, TextRestorer
from tests.test_documents import vault


def test_extract_json():
    assert extract_json('x {"a": 1} y') == {"a": 1} and extract_json('```json\n{"a": [1, 2]}\n```') == {"a": [1, 2]}
    assert extract_json('{"a": {"b": [1, 2, {"c": "x"}], "d": "unfini') == {"a": {"b": [1, 2, {"c": "x"}]}}
    assert extract_json('{"a": 1, "b": 23') == {"a": 1} and extract_json('{"a": "q\\"}", "b": [tr') == {"a": 'q"}', "b": []} and extract_json("none") is None and extract_json(None) is None
    inner = json.dumps({"deep": json.dumps(["x", {"k": "y"}])})
    assert set(decoded_strings(inner)) == {"deep", "x", "k", "y"} and readable("plain") == "plain"
    assert [p for p, _ in strings({"a": ["x", {"b": "y"}], "c": 1})] == [("a", 0), ("a", 1, "b")]


def body():
    return {
        "system": [{"type": "text", "text": "Primary working directory: /work/Quorvane Shipping Ltd"}],
        "messages": [
            {"role": "user", "content": "Ada Brenner wrote to Quorvane Shipping Ltd"},
            {"role": "assistant", "content": [{"type": "text", "text": "I see Ada Brenner"}, {"type": "tool_use", "name": "Read", "input": {"path": "/work/Ada Brenner - note.md"}}]},
            {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "Zielinski Henry"}, {"type": "image", "source": {}}]}, {"type": "thinking", "thinking": "Ada Brenner"}]},
        ],
    }


def test_prepare_and_restore():
    v, restores = vault(), R.Restores()
    restores.put("text", "I see Ada Brenner", "I see PERSON_1")
    out = R.prepare(body(), v, restores=restores)
    sent = json.dumps(out["body"], ensure_ascii=False)
    assert sent.count("Ada Brenner") == 1  # thinking goes on untouched
    assert "Quorvane" not in sent and "Zielinski" not in sent and out["withheld"] == ["image"] and out["restored"] == 1
    assert out["body"]["messages"][1]["content"][0]["text"] == "I see PERSON_1"
    token = v.token_for("Ada Brenner")
    answer = {"content": [{"type": "text", "text": f"{token} asks; see `{token} - note.md`"}, {"type": "tool_use", "name": "Read", "input": {"path": f"/work/{token} - note.md"}}, {"type": "tool_use", "name": "web", "input": {"q": token}}]}
    got = R.restore_answer(answer, out["mapping"], restores, out["spellings"])
    assert got["content"][0]["text"] == "Ada Brenner asks; see `Ada Brenner - note.md`" and got["content"][1]["input"]["path"] == "/work/Ada Brenner - note.md" and got["content"][2]["input"]["q"] == token
    assert restores.get("text", got["content"][0]["text"]) == answer["content"][0]["text"]
    with pytest.raises(R.Refused):
        R.prepare(body(), v, binary="refuse")
    with pytest.raises(R.Refused):
        R.prepare({"messages": [{"role": "user", "content": [{"type": "new"}]}]}, v)
    assert R.working_folder(body()) == "/work/Quorvane"


def test_responses_body():
    v = vault()
    b = {"instructions": "for Ada Brenner", "metadata": {"x": "Ada Brenner"}, "input": [{"type": "message", "role": "user", "content": [{"type": "input_text", "text": "Ada Brenner"}]}, {"type": "function_call", "name": "shell", "arguments": '{"p": "Ada Brenner"}'}, {"type": "function_call_output", "output": "Ada Brenner"}, {"type": "reasoning", "content": None}]}
    out = R.prepare(b, v)
    assert "Brenner" not in json.dumps(out["body"])
    assert R.drop_namespaces([{"name": "web.search"}, {"name": "shell"}, {"name": "mcp__x"}], ["web", "mcp"]) == [{"name": "shell"}]
    assert R.is_local_script(["Read", "Bash"]) and not R.is_local_script(["Read", "web"])


def test_spellings_keep_files_as_written():
    v = vault()
    texts = ["ls:\n/work/BRENNER, Ada/letter to quorvane.txt\n04 Brenner, Ada - note.md"]
    reds = [v.redact(t) for t in texts]
    table = R.spellings(texts, reds)
    assert R.back(reds[0]["text"], reds[0]["mapping"], table) == texts[0]
    t = v.token_for("Ada Brenner")
    assert R.back(f"04 {t} - note.md", {t: "x"}, table) == "04 Brenner, Ada - note.md"
    assert R.respell("no tokens", table) == "no tokens" and R.holdback(f"see `04 {t}", table) > 0 and R.holdback("plain text", table) == 0


def test_any_cut_of_a_stream_gives_the_same_text():
    v = vault()
    text = "Ada Brenner met Henry Zielinski; `Brenner, Ada.md` and QUORVANE SHIPPING LIMITED."
    red = v.redact(text)
    table = R.spellings([text], [red])
    want = R.back(red["text"], red["mapping"], table, prose=True)
    for seed in range(60):
        r = random.Random(seed)
        block, shown, at = TextRestorer(red["mapping"], table), "", 0
        while at < len(red["text"]):
            n = r.randrange(1, 9)
            shown += block.feed(red["text"][at : at + n])
            assert want.startswith(shown)
            at += n
        assert shown + block.finish() == want


def test_events():
    v = vault()
    red = v.redact("Ada Brenner reads")
    token = v.token_for("Ada Brenner")
    r = EventRestorer(red["mapping"])
    out = []
    ev = lambda **d: out.extend(r.event(d["type"], d))
    ev(type="message_start", message={"usage": {"input_tokens": 7}})
    ev(type="content_block_start", index=0, content_block={"type": "text", "text": token[:4]})
    ev(type="content_block_delta", index=0, delta={"type": "text_delta", "text": token[4:] + " rea"})
    ev(type="content_block_delta", index=0, delta={"type": "text_delta", "text": "ds " + token[:5]})
    ev(type="content_block_stop", index=0)
    ev(type="content_block_start", index=1, content_block={"type": "tool_use", "name": "Read"})
    ev(type="content_block_delta", index=1, delta={"type": "input_json_delta", "partial_json": '{"p": "'})
    ev(type="content_block_delta", index=1, delta={"type": "input_json_delta", "partial_json": token + '"}'})
    ev(type="content_block_stop", index=1)
    ev(type="message_delta", usage={"output_tokens": 3})
    text = "".join(d["delta"]["text"] for _, d in out if d.get("delta", {}).get("type") == "text_delta")
    assert text == "Ada Brenner reads " + token[:5]
    assert [json.loads(d["delta"]["partial_json"]) for _, d in out if d.get("delta", {}).get("type") == "input_json_delta"] == [{"p": "Ada Brenner"}]
    assert r.usage == {"input_tokens": 7, "output_tokens": 3}
    s = EventRestorer(red["mapping"])
    out = []
    for i, d in enumerate([{"type": "response.output_text.delta", "delta": token[:6]}, {"type": "response.output_text.delta", "delta": token[6:]}, {"type": "response.output_text.done", "text": token}]):
        out += s.event(d["type"], {"output_index": 0, "content_index": 0, "sequence_number": i, **d})
    assert "".join(d.get("delta", "") for _, d in out) == "Ada Brenner" and out[-1][1]["text"] == "Ada Brenner"
    assert [d["sequence_number"] for _, d in out] == list(range(out[0][1]["sequence_number"], out[0][1]["sequence_number"] + len(out)))


def test_sse():
    raw = ": hi\nevent: a\ndata: 1\ndata: 2\n\ndata:x\n"
    assert list(sse.events(raw.split("\n"))) == [("", ": hi"), ("a", "1\n2"), ("", "x")]
    assert list(sse.events(sse.encode("n", {"k": "é\n"}).split("\n"))) == [("n", '{"k":"é\\n"}')]
