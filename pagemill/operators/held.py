"""All rule packs of a document in its own row: text in, extractions out, in one Arrow pass without a shuffle.

``operators.extract`` states the packs over token tables, which have to be written and moved. Every rule stays within
a document, so where one row holds the whole document no token has to leave it. Results are those of
``extract.extractions`` over ``tokens.annotate``; entities are grouped only in sections that a hit asks for.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import extract
from pagemill.operators.patterns import steps_of
from pagemill.operators.tokens import HEADINGS, Annotator, annotator_of, local_annotator, read_documents
from pagemill.runtime import ship

_numbers = re.compile("[0-9]+").findall

#: Entity marks of a run of forms, from the position of its first form on.
Marker = Callable[[list[str], int], list[str | None]]


class Document:
    """Positions, sentences and sections of one annotated document."""

    def __init__(self, forms: list[str], lemmas: list[str], marks: list[str | None], sizes: list[int], ids: list[int], tags: list[str], wanted: frozenset[str], marker: Marker | None):
        self.forms, self.lemmas, self.marks, self.ids, self.marker = forms, lemmas, marks, ids, marker
        self.last = len(forms) - 1
        self.where: dict[str, list[int]] = {}
        for pos, lemma in enumerate(lemmas):
            if lemma in wanted:
                self.where.setdefault(lemma, []).append(pos)
        self.elements, at = [], 0
        for size in sizes:
            self.elements.append(at)
            at += size
        self.dots = [pos for pos, form in enumerate(forms) if form == "."]
        self.sentences = sorted({*self.elements, *(pos + 1 for pos in self.dots if pos < self.last)})
        self.sections = sorted({0, *(at for at, tag in zip(self.elements, tags) if tag in HEADINGS)})
        self._entities: dict[int, list[tuple[str, str, int, int, str]]] = {}

    def matches(self, steps: list[tuple[int, str, bool]], size: int, mode: str = "strict") -> list[tuple[int, int]]:
        """(start, end) of every match of one pattern, as ``patterns.pack_matches`` has it."""
        found, where, lemmas = [], self.where, self.lemmas
        if any(lemma not in where for _, lemma, _ in steps):
            return found
        for start in where[steps[0][1]]:
            if start > self.last + 1 - size:
                break
            at, end = start, 0
            if mode == "sentence":
                stop = bisect_right(self.dots, start)
                bound = self.dots[stop] if stop < len(self.dots) else self.last + 1
            for gap, lemma, wild in steps[1:]:
                if mode == "sentence":
                    places = where[lemma]
                    i = bisect_left(places, at)
                    at = places[i] if i < len(places) and places[i] < bound else -1
                else:
                    at = next((q for q in range(at + 1, min(at + 2 + gap, self.last + 1)) if lemmas[q] == lemma), -1)
                    end = at if wild else end
                if at < 0:
                    break
            if 0 <= at < self.last:
                found.append((start, at if mode == "sentence" else end))
        return found

    def sentence(self, pos: int) -> int:
        return bisect_right(self.sentences, pos) - 1

    def span(self, sentence: int) -> tuple[int, int]:
        """First position of a sentence and the one after its last."""
        return self.sentences[sentence], self.sentences[sentence + 1] if sentence + 1 < len(self.sentences) else self.last + 1

    def text(self, first: int, end: int) -> str:
        return " ".join(self.forms[first:end])

    def section(self, pos: int) -> int:
        """Start of the section that holds a position before the last."""
        return self.sections[bisect_right(self.sections, pos) - 1]

    def section_end(self, start: int) -> int:
        at = bisect_right(self.sections, start)
        return min(self.sections[at] if at < len(self.sections) else self.last, self.last)

    def entities(self, start: int) -> list[tuple[str, str, int, int, str]]:
        """(ent_type, ne_id, start, end, text) of the entities that start in a section."""
        if start not in self._entities:
            at = bisect_right(self.sections, start)
            end = self.sections[at] if at < len(self.sections) else self.last + 1
            marks = self.marker(self.forms[start:end], start) if self.marker else self.marks[start:end]
            groups: dict[tuple[str, str, int], list[int]] = {}
            for pos, mark in enumerate(marks, start):
                if mark is not None:
                    element = self.ids[bisect_right(self.elements, pos) - 1]
                    for part in mark.split("-"):
                        kind, number = part.split("_")[:2]
                        groups.setdefault((kind, number, element), []).append(pos)
            self._entities[start] = [
                (kind, number, own[0], own[-1], " ".join(self.forms[p] for p in own)) for (kind, number, _), own in groups.items() if own[0] < self.last
            ]
        return self._entities[start]


class Packs:
    """Rule packs made ready for documents."""

    def __init__(self, controller, parties, duration, access, delete, deadline, starts, named, unit, word):
        ready = lambda rules: [(steps_of(rule.split()), len(rule.split())) for rule in rules]
        self.controller, self.parties, self.duration = ready(controller), ready(parties), ready(duration)
        self.sentences = {"access": ready(access), "delete": ready(delete), "lhuta": ready(deadline)}
        self.named = {name: ready([f"{start} {suffix}" for start in starts]) for name, suffix in named.items()}
        self.unit, self.unit_size, self.word = steps_of(list(unit)), len(unit), word
        every = [*self.controller, *self.parties, *self.duration, *(r for own in (*self.sentences.values(), *self.named.values()) for r in own)]
        self.lemmas = frozenset({word, *(lemma for steps, _ in [*every, (self.unit, 0)] for _, lemma, _ in steps)})
        self.no_party = {name.lower() for name in extract.NO_PARTY}

    def extract(self, doc: Document) -> list[tuple[str, str]]:
        """(type, text) of one document."""
        out = self._controller(doc)
        out += [("third_companies", text) for text in self._third_parties(doc)]
        out += [("duration", text) for text in self._duration(doc)]
        for kind, rules in self.sentences.items():
            out += [(kind, doc.text(*doc.span(s))) for s in self._sentences(doc, rules)]
        for rules in self.named.values():
            out += [("druh", doc.text(*doc.span(s))) for s in self._sentences(doc, rules, "sentence")]
        return out

    def _of_types(self, doc: Document, section: int, types: list[str], names: set[str]) -> list[tuple[str, str, int, int, str]]:
        return [e for e in doc.entities(section) if e[0] in types and e[4].strip(" ").lower() not in names]

    def _controller(self, doc: Document) -> list[tuple[str, str]]:
        near = lambda found, to: min(found, key=lambda e: (abs(e[2] - to), e[2], e[0], e[1]))
        picked, seen = None, set()
        for hit in sorted({start for steps, size in self.controller for start, _ in doc.matches(steps, size)}):
            section = doc.section(hit)
            if section in seen:
                continue
            seen.add(section)
            parties = self._of_types(doc, section, extract.PARTY_TYPES, self.no_party)
            if not parties:
                continue
            party = near(parties, section)
            addresses = self._of_types(doc, section, extract.ADDRESS_TYPES, set())
            if addresses:
                return [("company", party[4]), ("address", near(addresses, (party[2] + party[3]) // 2)[4])]
            picked = picked or [("company", party[4])]
        return picked or []

    def _third_parties(self, doc: Document) -> list[str]:
        hits = [doc.section(start) for steps, size in self.parties for start, _ in doc.matches(steps, size)]
        texts = dict.fromkeys(e[4] for section in dict.fromkeys(hits) for e in self._of_types(doc, section, extract.PARTY_TYPES, self.no_party))
        return list(texts) or [doc.text(section, doc.section_end(section)) for section in hits]

    def _sentences(self, doc: Document, rules: list, mode: str = "strict") -> list[int]:
        return sorted({doc.sentence(pos) for steps, size in rules for match in doc.matches(steps, size, mode) for pos in match})

    def _duration(self, doc: Document) -> list[str]:
        found, units = [], None
        for sentence in self._sentences(doc, self.duration):
            first, end = doc.span(sentence)
            units = doc.matches(self.unit, self.unit_size) if units is None else units
            spans = [(a, b + 1) for a, b in units if first <= a <= end - 1 - self.unit_size]
            found += [(int(n), text) for text in (doc.text(a, b) for a, b in spans) for n in _numbers(text)]
            places = [] if spans else doc.where.get(self.word, [])
            at = bisect_left(places, first)
            if at < len(places) and places[at] < end - 1:
                found.append((0, doc.text(max(0, places[at] - 5), places[at] + 5)))
        return [max(found)[1]] if found else []


def extractions(
    docs: DataFrame, key: str = "doc_id", elements: str = "elements", controller_rules=extract.CONTROLLER, party_rules=extract.THIRD_PARTIES, duration_rules=extract.DURATION, access_rules=extract.ACCESS, delete_rules=extract.DELETE, deadline_rules=extract.DEADLINE, starts=extract.CATEGORY_STARTS, named=extract.CATEGORIES, unit=("po", "doba", "*1", "léta"), word="doba", factory: Callable[[], Annotator] = local_annotator, marker: Marker | None = None, heading_words: int = 4,
) -> DataFrame:
    """(key, type, text) of documents with one row each: ``elements`` as ``tokens.annotate`` takes it.

    ``marker`` replaces the annotator's entity marks. Rows without a key give none, as no join finds them.
    """
    ship(docs.sparkSession)
    rules = (controller_rules, party_rules, duration_rules, access_rules, delete_rules, deadline_rules, starts, named, unit, word)

    def run(batches):
        annotator, packs = annotator_of(factory), Packs(*rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, kinds, texts = [], [], []
                for i, own in enumerate(read_documents(part, annotator, heading_words)):
                    if own[0]:
                        for kind, text in packs.extract(Document(*own, packs.lemmas, marker)):
                            rows.append(i)
                            kinds.append(kind)
                            texts.append(text)
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, "type", "text"])

    held = docs.where(F.col(key).isNotNull()).select(key, elements)
    return held.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, type string, text string")
