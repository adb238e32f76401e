"""From raw match documents to the delivery log, with everything that is left out accounted for."""
from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..functions.rules import divide
from ..operators import normalize as n
from ..session import written
from ..sources.documents import parse_documents


class Prepared(NamedTuple):
    log: DataFrame
    duplicates: DataFrame       # match_id, fingerprint of later copies
    exclusions: DataFrame       # match_id, reason
    quarantine: DataFrame       # deliveries with reject_reason


def prepare(texts: DataFrame, venue_names: Mapping[str, str] | None = None, team_names: Mapping[str, str] | None = None) -> Prepared:
    """Duplicates out, matches judged, the rest flattened, deliveries that break a rule set apart.

    ``texts`` is (match_id, text) and is read twice. Fingerprints are written without their texts, as deduplication reads them twice; the
    names of later copies are far fewer than those kept, so the texts are kept against them. The judged documents are written once:
    log, quarantine and exclusions read them without parsing again.
    """
    marked = written(n.fingerprinted(texts.select("match_id", "text")).select("match_id", "fingerprint"), "fingerprints")
    _, dropped = n.drop_duplicates_first(marked, "fingerprint", "match_id")
    dropped = written(dropped, "duplicates")
    # A text without a name is nobody's first, as in the operator.
    kept = texts.select("match_id", "text").where("match_id is not null").join(dropped.select("match_id"), "match_id", "left_anti")
    judged = written(n.judge(parse_documents(kept)), "judged", compression="zstd")
    flat = n.flatten(judged.filter("reason IS NULL"), venue_names, team_names)
    good, bad = divide(flat, {**n.identity_rules(), **n.accounting_rules()})
    return Prepared(good.drop("unknown_names", "extras_sum"), dropped.select("match_id", "fingerprint"), n.exclusions(judged), bad)
