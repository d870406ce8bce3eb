"""Answers with more than one defect."""

from skeinworks.llm import answers


def test_every_triggered_defect_is_given():
    q = "Where was the early ferry of Acme Foods opened during the spring session?"
    assert answers.defects(q, "Es tut mir leid, ich kann diese Frage leider nicht beantworten, weil das nicht erlaubt ist.") == ["refusal", "wrong_language"]
    assert answers.defects(q, "I can't help with that request (") == ["refusal", "truncated"]
    assert answers.defects(q, f'"{q}') == ["question_copy", "truncated"]
    assert answers.defects(q, "I apologize, but I have to refuse this question") == ["refusal"]
