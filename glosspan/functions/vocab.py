"""Word lists and the default rule pack, loaded once from the vocabulary file."""

from __future__ import annotations

import json
import pkgutil
from functools import lru_cache


@lru_cache(maxsize=1)
def lists() -> dict:
    return json.loads(pkgutil.get_data(__name__.rpartition(".")[0], "vocabulary.json").decode())


def words(name: str) -> list[str]:
    return list(lists()[name])


LIMITS = dict(maxNounClusterLength=3, maxSentencesPerProceduralStep=1, descriptiveMaxGradeLevel=8.0, proceduralMaxGradeLevel=7.0,
              sentenceReadabilityFloorWords=20)
