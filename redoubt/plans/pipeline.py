"""The whole run over a corpus, and its first half."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import LeakError
from ..operators import classify as K
from ..operators import detect as D
from ..operators import provenance as P
from ..operators import redact as X
from ..session import settle
from ..sources import text as T
from .policies import PRIVACY, Policy


@dataclass
class Analysis:
    nodes: DataFrame
    all: DataFrame
    findings: DataFrame
    classified: dict[str, DataFrame]


@dataclass
class Redaction:
    analysis: Analysis
    operations: DataFrame
    retained: DataFrame
    output: DataFrame
    verification: dict[str, DataFrame]
    entries: DataFrame | None
    manifest: DataFrame | None

    def texts(self) -> DataFrame:
        """Redacted texts of the documents that passed."""
        return T.join_paragraphs(X.released(self.output, self.verification["report"]))


def analyze(docs: DataFrame, policy: Policy = PRIVACY, nodes: DataFrame | None = None, **detect) -> Analysis:
    """Detection and classification; nothing is changed."""
    nodes = settle(T.nodes(docs) if nodes is None else nodes)
    every, found = D.detect(nodes, **detect)
    return Analysis(nodes, every, found, K.classify(policy, docs, nodes, found))


def redact(docs: DataFrame, policy: Policy = PRIVACY, options: X.PlanOptions = X.PlanOptions(), salt: bytes | None = None, exclude: DataFrame | None = None, sign=None, strict: bool = False, nodes: DataFrame | None = None, **detect) -> Redaction:
    """Detect, classify, plan, apply, verify, and with a salt, list what was withheld.

    A leak refuses its document and no other; ``strict`` raises instead."""
    a = analyze(docs, policy, nodes, **detect)
    ops, retained = X.plan(a.nodes, a.classified["eligible"], a.classified["portions"], options, exclude)
    ops, retained = settle(ops), settle(retained)
    output = settle(X.apply(a.nodes, ops))
    checked = X.verify(ops, retained, output, documents=docs)
    checked["report"] = settle(checked["report"])
    if strict and (leaks := checked["leaks"].take(20)):
        raise LeakError([r.asDict() for r in leaks])
    entries = settle(P.manifest_entries(ops, a.all, salt)) if salt else None
    manifest = P.manifests(entries, a.classified["documents"], checked["report"], policy, a.nodes, output, sign=sign) if salt else None
    return Redaction(a, ops, retained, output, checked, entries, manifest)
