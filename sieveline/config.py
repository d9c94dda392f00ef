"""Parameters of the curation stages, as frozen dataclasses; vocabularies are data, never code."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from importlib import resources


@dataclass(frozen=True)
class Stratum:
    """One class of a keyword classifier. A keyword scores 1 where it occurs, a source pattern 2 in the source."""

    name: str
    keywords: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    share: float = 0.0
    description: str = ""


@dataclass(frozen=True)
class Classifier:
    """Strata in order of precedence at ties; fallback if none scores."""

    strata: tuple[Stratum, ...]
    fallback: str
    #: (society, category) that decide for `boosted` outright.
    society: str | None = None
    category: str | None = None
    boosted: str = ""


_DATA = json.loads(resources.files(__package__).joinpath("vocabularies.json").read_text("utf-8"))


def _classifier(name: str) -> Classifier:
    c = _DATA[name]
    strata = tuple(Stratum(s["name"], tuple(s.get("keywords", ())), tuple(s.get("sources", ())), s.get("share", 0.0), s.get("description", "")) for s in c["strata"])
    return Classifier(strata, c["fallback"], c["society"], c["category"], c["boosted"])


#: Full-corpus and sampler vocabularies (substring tests, no word bounds); FIXTURE: one for invented prose, of frequent
#: syllables, so that every stratum occurs.
SAMPLER, EXTRACTOR, EXAMPLES, FIXTURE = map(_classifier, ("sampler", "extractor", "examples", "fixture"))

BOILERPLATE = tuple(_DATA["boilerplate"])

#: Refusals and evasions, matched anywhere without word bounds, ignoring case; with a pattern that does occur in the
#: fixtures.
EVASIVE = "|".join(_DATA["evasive"])
EVASIVE_FIXTURE = "|".join(_DATA["evasive"] + _DATA["evasive_in_fixtures"])

#: What a prompt asks for, by stratum.
HINTS: dict[str, str] = _DATA["hints"]


@dataclass(frozen=True)
class FunnelConfig:
    min_chunk: int = 80
    min_alpha: float = 0.4
    min_response: int = 300
    min_question: int = 30
    min_answer: int = 30
    similarity: float = 0.95
    sample_fraction: float = 0.05
    min_score: int = 3
    max_share: float = 0.40
    balance_rounds: int = 10
    seed: int = 42
    evasive: str = EVASIVE
    classifier: Classifier = EXAMPLES
    system_prompt: str = "You answer from the given guidelines."
    #: Stages that aren't built into the plan; trees of the extrapolation.
    skip: frozenset[str] = field(default_factory=frozenset)
    trees: int = 200
    #: Files of the whole run: JSON lines and their source, scores, results. A dry run leaves a report only.
    input_dir: str = "data"
    output_dir: str = "data/clean"
    inputs: tuple[tuple[str, str], ...] = (("all_examples.jsonl", "sonnet"), ("batch1.jsonl", "minimax"), ("batch2.jsonl", "minimax"))
    scores_file: str | None = None
    dry_run: bool = False


@dataclass(frozen=True)
class GenerationConfig:
    """limit: chunks to take, by id (0: all); resume: leave out what the output has; partitions: calls at a time;
    per_minute: calls (0: no limit); timeout: seconds a call may take (0: any)."""

    limit: int = 0
    resume: bool = True
    partitions: int = 8
    per_minute: float = 0
    timeout: float = 0
    pairs_per_chunk: int = 3
    input_tokens: int = 800
    output_tokens: int = 600
    input_price: float = 3.0
    output_price: float = 15.0
    seconds_per_chunk: float = 1.2
    hints: dict = field(default_factory=lambda: dict(HINTS))
