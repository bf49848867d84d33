"""The whole scan as one set of lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators import exports, external, findings, metrics, snippets
from siftspark.operators import notes as notes_
from siftspark.options import ScanOptions
from siftspark.sources import files as S
from siftspark.sources.landing import landed


@dataclass(frozen=True)
class Scan:
    """Nothing here has run yet; each member is a plan that reads the corpus when it is used."""

    files: DataFrame
    skipped: DataFrame
    raw_findings: DataFrame       # before suppression, without fingerprints
    findings: DataFrame           # processed and enriched
    snippets: DataFrame
    catalog: DataFrame
    options: ScanOptions
    notes: DataFrame | None = None        # (repo, stage, path, note) of the scan itself
    reviewed: bool = False                # an external review took part
    unchanged: DataFrame | None = None    # raw_findings as the scan of ``files`` made them

    def settled(self) -> Scan:
        """The same scan with its findings written once: reports read them several times."""
        return replace(self, findings=landed(self.findings, "findings"),
                       skipped=landed(self.skipped, "skipped"))

    def summary(self) -> DataFrame:
        return metrics.scan_summary(self.files, self.skipped, self.options)

    def first_snippets(self) -> DataFrame:
        return snippets.first_snippets(self.snippets, self.options.max_snippets)

    def requests(self) -> DataFrame:
        return external.prompt_batches(self.files, self.catalog, self.options)

    def gate(self, processed: bool = True) -> DataFrame:
        found = self.findings if processed else findings.enrich(self.raw_findings, self.catalog)
        return metrics.severity_gate(found, self.files, self.options.fail_on_severity)

    def reports(self, notes: DataFrame | None = None) -> dict[str, DataFrame]:
        total = landed(self.summary(), "summary")
        if notes is None and self.notes is not None:
            notes = self.notes if self.reviewed else self.notes.unionByName(notes_.disabled_notes(total))
        masks = self.options.redactions
        return {
            "json": exports.export_json(self.findings, total, self.catalog, self.options, notes,
                                        self.skipped, languages=metrics.files_by_language(
                                            self.files), reviewed=self.reviewed),
            "sarif": exports.export_sarif(self.findings, total, self.catalog, masks),
            "markdown": exports.export_markdown(self.findings, total, self.catalog, notes,
                                                self.skipped, redactions=masks,
                                                max_snippets=self.options.max_snippets),
            "html": exports.export_html(self.findings, total, masks),
        }


def scan(raw: DataFrame, catalog: DataFrame, options: ScanOptions = ScanOptions(),
         globs: tuple[str, ...] | None = None) -> Scan:
    """Scan raw(repo, path, length, content)."""
    files = S.collect_files(raw, options, globs)
    result = scan_files(files, S.skip_ledger(raw, options, globs), catalog, options)
    return replace(result, notes=notes_.scan_notes(raw, options, globs))


def scan_files(files: DataFrame, skipped: DataFrame, catalog: DataFrame,
               options: ScanOptions = ScanOptions()) -> Scan:
    """Scan code files that are already text: files(repo, path, language, text)."""
    raw = findings.raw_findings(files, options)
    return Scan(
        files=files, skipped=skipped, raw_findings=raw, unchanged=raw,
        findings=findings.enrich(findings.findings(files, options), catalog),
        snippets=snippets.snippets(files, options),
        catalog=catalog, options=options,
    )


def reviewed(result: Scan, responses: DataFrame) -> Scan:
    """The scan after the answers of an external reviewer: gate and reports cover its findings too.

    External findings enter before suppression, as the scan's own do, so the merged rows pass
    through suppression and fingerprints once more on the table side. An answer whose repo has no
    file is in the notes alone; without answers the findings are the scan's own.
    """
    proposals = landed(external.parse_responses(responses), "proposals")
    # One pass over the corpus: what is found, what is suppressed, and what proposals are tested against.
    facts = external.facts_of(proposals, result.files, result.options)
    judged = landed(external.judge(proposals, result.files, result.catalog, result.options, facts),
                    "judged")
    own = findings.raw_of(facts, result.options) if result.raw_findings is result.unchanged else result.raw_findings
    merged = findings.merge_findings(own, external.accepted(judged, result.options))
    marks = findings.marks_of(facts)
    kept = findings.fingerprint_dedupe(findings.suppress(merged, marks), findings.MERGED_ORDER)
    enriched = findings.enrich(kept, result.catalog).withColumn(
        "recommendation", F.expr("coalesce(own_recommendation, recommendation)")
    ).drop("own_recommendation", "request_id")
    notes = notes_.review_notes(proposals, judged.where("reason != 'accepted'"))
    if result.notes is not None:
        notes = result.notes.unionByName(notes)
    return replace(result, raw_findings=merged, findings=enriched, notes=notes, reviewed=True)


def with_external(result: Scan, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, notes) after the answers of an external reviewer are validated and merged."""
    after = reviewed(result, responses)
    return after.findings, after.notes
