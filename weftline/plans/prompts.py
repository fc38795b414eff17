"""Prompt texts: extraction with examples, answers, keywords."""

from __future__ import annotations

from weftline.operators.extraction import DONE, FIELD, RECORD

EXTRACT = """You read a passage and write down what it says as records, in {language}.

For each statement of the passage write one record
("hyper-relation"{field}<the statement as one full sentence>{field}<how sure the passage is, 0 to 10>)
and right after it, for each person, place, thing or idea that it names, one record
("entity"{field}<name>{field}<one of: {types}>{field}<what the statement says of it>{field}<how central it is, 0 to 100>)

Put {record} between records and {done} at the end. Write nothing else.

{examples}
Passage:
{input_text}
Records:
"""

_EXAMPLES = (
    ("Mira repaired the old mill by the river.", "Mira repaired the old mill by the river.", (("Mira", "person", "She repaired the mill.", 90), ("old mill", "place", "It stands by the river and was repaired.", 80))),
    ("Copper rusts green in sea air.", "Copper rusts green in sea air.", (("copper", "thing", "It turns green.", 90), ("sea air", "thing", "It makes copper rust.", 60))),
)


def example(passage: str, statement: str, entities: tuple) -> str:
    rows = [f'("hyper-relation"{FIELD}"{statement}"{FIELD}9)', *(f'("entity"{FIELD}"{n}"{FIELD}"{t}"{FIELD}"{d}"{FIELD}{w})' for n, t, d, w in entities)]
    return f"Passage:\n{passage}\nRecords:\n{RECORD.join(rows)}{DONE}\n"


def extraction_template(language: str = "English", types: tuple[str, ...] = ("person", "place", "organisation", "event", "thing", "idea"), examples: int = 2) -> str:
    """The extraction prompt but for its {input_text}, with that many examples."""
    slots = {"language": language, "types": ", ".join(types), "field": FIELD, "record": RECORD, "done": DONE, "examples": "\n".join(example(*e) for e in _EXAMPLES[:examples])}
    out = EXTRACT
    for name, value in slots.items():
        out = out.replace("{" + name + "}", value)
    return out


MORE = "Some statements of the passage are still missing. Write their records in the same form."
AGAIN = "Is anything still missing? Answer YES or NO."

#: How an answer is asked for, with sources and without, and what is said when there is nothing to say.
ANSWER = "Answer the question from the sources alone, and name those that you used.\n\nSources:\n{context}\n\nQuestion: {question}\n"
NAIVE = "Answer the question from these passages alone.\n\nPassages:\n{context}\n\nQuestion: {question}\n"
NOTHING = "The sources do not answer this question."
SIMILAR = "How alike are these two questions in what they ask, from 0 to 1? Answer with the number.\n\nFirst: {question}\nSecond: {other}\n"

KEYWORDS = 'Name the themes and the particular things that the question is about, as JSON: {"high_level_keywords": [...], "low_level_keywords": [...]}\n\nQuestion: {question}\n'

