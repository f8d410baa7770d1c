"""Templates that look at a turn's position or at how a conversation starts."""

import pytest

from feedloom.llm import chat


def numbered(turns):
    return "".join(f"Turn {i}: {role}> {text}\n" for i, (role, text) in enumerate(turns, 1))


def user_first(turns):
    if turns and turns[0][0] != "user":
        raise ValueError("conversations start with a user turn")
    return "".join(f"[{role}] {text}</s>" for role, text in turns)


@pytest.mark.parametrize("template", [numbered, user_first])
@pytest.mark.parametrize("n", [32, 33, 65, 100])
def test_prefixes_decide(template, n):
    turns = [(("user", "assistant")[i % 2], f"t{i}") for i in range(n)]
    whole, spans, texts, rewrites = chat.locate(turns, template)
    assert whole == template(turns) and not rewrites
    assert [whole[a:b] for a, b in texts] == [t for _, t in turns]
    assert [whole[a:b] for a, b in spans] == [template(turns[: i + 1])[len(template(turns[:i])) :] for i in range(n)]


def test_rewriting_far_back_is_found():
    forgets = lambda turns: "".join(f"<{t if i >= len(turns) - 50 else ''}>" for i, (_, t) in enumerate(turns))
    assert chat.locate([("user", f"t{i}") for i in range(100)], forgets)[3]
    assert not chat.locate([("user", f"t{i}") for i in range(50)], forgets)[3]
