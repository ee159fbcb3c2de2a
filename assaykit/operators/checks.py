"""Quality checks: what each one counts, and how counts become findings.

A check names row predicates; the engine counts all predicates of all checks in one pass. The
check then describes its findings as SQL over those counts, so that the same plan validates one
table or thousands of batches (one row of counts each) without going through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.config import NULL_POLICY, NULL_POLICY_DEFAULT, Settings
from assaykit.functions.dates import parse_date
from assaykit.functions.values import holds, ref, same_family, text_literal, to_number
from assaykit.operators.measure import REPEATS, ROWS

FINDING_FIELDS = {
    "check_name": "string",
    "category": "string",
    "status": "string",
    "severity": "string",
    "message": "string",
    "affected_rows": "bigint",
    "affected_percentage": "double",
    "metadata": "map<string,string>",
}
FINDING_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in FINDING_FIELDS.items()) + ">"
# A map cannot be ordered, so lists that get sorted leave it out.
SORTABLE_FIELDS = [n for n in FINDING_FIELDS if n != "metadata"]


@dataclass(frozen=True)
class Table:
    """What a check may know before any row is read."""

    dtypes: Mapping[str, str]
    settings: Settings

    @property
    def columns(self) -> list[str]:
        return list(self.dtypes)

    def has(self, *names: str) -> bool:
        return set(names) <= set(self.dtypes)

    def number(self, name: str) -> Column:
        return to_number(name, self.dtypes[name])

    def date(self, name: str) -> Column:
        return parse_date(ref(name), self.dtypes[name], self.settings.extra_date_formats)


class Counts:
    """Names of the counts of one check, for use in SQL."""

    rows = ROWS
    repeats = REPEATS

    def __init__(self, prefix: str) -> None:
        self._prefix = prefix

    def __getitem__(self, name: str) -> str:
        return "`" + (self._prefix + name).replace("`", "``") + "`"


@dataclass(frozen=True)
class Outcome:
    """One possible result of a rule.

    ``when``, ``rows``, ``args`` and the metadata values are SQL over counts; ``message`` has a
    ``%s`` for each of ``args``. The last outcome of a rule has no condition.
    """

    status: str
    severity: str
    message: str
    args: tuple[str, ...] = ()
    when: str | None = None
    rows: str = "0"
    percentage: str | None = None
    metadata: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Finding:
    """A named rule with its outcomes, first match wins. ``given`` leaves the finding out if false."""

    check_name: str
    category: str
    outcomes: tuple[Outcome, ...]
    given: str | None = None


@dataclass(frozen=True)
class Check:
    """A check. ``predicates(table)`` names row conditions, ``findings(table, counts)`` returns the
    rules over their counts. ``frame(df, by)`` is the alternative for a check that needs its own
    plan: it returns finding rows with the ``by`` columns, and may add ``finding_order`` and ``metadata``.
    """

    name: str
    category: str
    predicates: Callable[[Table], Mapping[str, Column]] = lambda table: {}
    findings: Callable[[Table, Counts], list[Finding]] = lambda table, counts: []
    needs_repeats: bool = False
    frame: Callable[[DataFrame, list[str]], DataFrame] | None = None


def share_of_rows(count: str) -> str:
    """SQL of a count as percentage of the rows, 2 decimals; 0 for an empty table."""
    return f"if({ROWS} > 0, round({count} / {ROWS} * 100, 2), 0.0D)"


def _outcome_sql(rule: Finding, outcome: Outcome) -> str:
    if outcome.args:
        message = f"format_string({text_literal(outcome.message)}, {', '.join(outcome.args)})"
    else:
        message = text_literal(outcome.message)
    percentage = outcome.percentage or ("0.0D" if outcome.rows == "0" else share_of_rows(outcome.rows))
    pairs = ", ".join(f"{text_literal(k)}, cast({v} as string)" for k, v in outcome.metadata.items())
    return (
        f"named_struct('check_name', {text_literal(rule.check_name)}, 'category', {text_literal(rule.category)},"
        f" 'status', '{outcome.status}', 'severity', '{outcome.severity}', 'message', {message},"
        f" 'affected_rows', cast({outcome.rows} as bigint), 'affected_percentage', cast({percentage} as double),"
        f" 'metadata', cast(map({pairs}) as map<string,string>))"
    )


def finding_sql(rule: Finding) -> str:
    """The finding as a struct, null where it does not apply."""
    value = _outcome_sql(rule, rule.outcomes[-1])
    whens = " ".join(f"WHEN {o.when} THEN {_outcome_sql(rule, o)}" for o in rule.outcomes[:-1])
    if whens:
        value = f"CASE {whens} ELSE {value} END"
    return f"if({rule.given}, {value}, null)" if rule.given else value


# Schema ------------------------------------------------------------------------------------------

def _schema_findings(columns: list[str], dtypes: Mapping[str, str]):
    def findings(table: Table, n: Counts) -> list[Finding]:
        limit = table.settings.unexpected_column_limit
        missing = [c for c in columns if c not in table.dtypes]
        extra = sorted(set(table.dtypes) - set(columns))
        wrong = [
            (c, t, table.dtypes[c])
            for c, t in dtypes.items()
            if c in table.dtypes and not same_family(table.dtypes[c], t)
        ]
        expected = text_literal(str(columns))

        presence = Outcome("PASS", "INFO", "All expected columns are present.", metadata={"expected": expected})
        if missing:
            presence = Outcome(
                "FAIL", "CRITICAL",
                f"{len(missing)} expected column(s) are missing: {missing}. Downstream checks will be unreliable.",
                rows=n.rows, percentage="100.0D",
                metadata={"missing_columns": text_literal(str(missing)), "expected": expected,
                          "actual": text_literal(str(table.columns))})

        unexpected = Outcome("PASS", "INFO", "No unexpected columns detected.")
        if extra:
            status, severity = ("WARNING", "MEDIUM") if len(extra) > limit else ("INFO", "LOW")
            unexpected = Outcome(
                status, severity,
                f"{len(extra)} unexpected column(s) found: {extra}. "
                "These may indicate schema drift or intentional additions.",
                metadata={"unexpected_columns": text_literal(str(extra))})

        types = Outcome("PASS", "INFO", "All column data types match expectations.",
                        metadata={"checked_columns": text_literal(str(list(dtypes)))})
        if wrong:
            types = Outcome(
                "WARNING", "MEDIUM",
                f"{len(wrong)} column(s) have unexpected data types. "
                "This may cause arithmetic or join operations to fail.",
                metadata={c: text_literal(f"expected {t}, found {a}") for c, t, a in wrong})
        return [
            Finding("column_presence", "schema", (presence,)),
            Finding("unexpected_columns", "schema", (unexpected,)),
            Finding("dtype_compatibility", "schema", (types,)),
        ]

    return findings


def schema_check(columns: list[str] | None = None, dtypes: Mapping[str, str] | None = None,
                 settings: Settings | None = None) -> Check:
    """Expected columns, unexpected columns, types. An empty override means the default contract."""
    contract = (settings or Settings()).columns
    return Check("SchemaCheck", "schema",
                 findings=_schema_findings(list(columns or contract), dict(dtypes or contract)))


# Completeness ------------------------------------------------------------------------------------

def _null_predicates(table: Table) -> dict[str, Column]:
    return {c: ref(c).isNull() for c in table.columns}


def _null_findings(table: Table, n: Counts) -> list[Finding]:
    found = []
    for c in table.columns:
        status, severity, remark = NULL_POLICY.get(c, NULL_POLICY_DEFAULT)
        shown = c.replace("%", "%%")
        found.append(Finding(f"{c}_completeness", "completeness", (
            Outcome("PASS", "INFO", f"{c} is 100% complete.", when=f"{n[c]} = 0"),
            Outcome(status, severity, f"{shown} is missing %s values (%s%%).{remark}",
                    (n[c], share_of_rows(n[c])), rows=n[c]),
        ), given=f"{n.rows} > 0"))
    return found


COMPLETENESS = Check("CompletenessCheck", "completeness", _null_predicates, _null_findings)


# Validity and business rules ---------------------------------------------------------------------

def cancelled(name: str = "InvoiceNo") -> Column:
    """Invoice text starts with ``C``; a missing invoice is not a cancellation."""
    return holds(ref(name).cast("string").startswith("C"))


def adjustment(table: Table) -> Column:
    """Negative quantity, no cancellation, price zero and no customer."""
    return (
        holds(table.number("Quantity") < 0)
        & ~cancelled()
        & holds(table.number("UnitPrice") == 0)
        & ref("CustomerID").isNull()
    )


def _validity_predicates(table: Table) -> dict[str, Column]:
    rules: dict[str, Column] = {}
    if table.has("UnitPrice"):
        price = table.number("UnitPrice")
        rules["price_negative"] = price < 0
        rules["price_zero"] = price == 0
    if table.has("Quantity", "InvoiceNo"):
        quantity, is_cancelled = table.number("Quantity"), cancelled()
        negative = holds(quantity < 0)
        exempt = adjustment(table) if table.has("UnitPrice", "CustomerID") else F.lit(False)
        rules["quantity_zero"] = quantity == 0
        rules["cancelled"] = is_cancelled
        rules["adjustment"] = exempt
        rules["negative_sale"] = negative & ~is_cancelled & ~exempt
        rules["positive_cancellation"] = is_cancelled & ~negative
    if table.has("InvoiceDate"):
        rules["bad_date"] = ref("InvoiceDate").isNotNull() & table.date("InvoiceDate").isNull()
    return rules


def _validity_findings(table: Table, n: Counts) -> list[Finding]:
    out = []

    def rule(name: str, *outcomes: Outcome) -> None:
        out.append(Finding(name, "validity", outcomes, given=f"{n.rows} > 0"))

    if table.has("UnitPrice"):
        low, free = n["price_negative"], n["price_zero"]
        rule("unit_price_validity",
             Outcome("FAIL", "HIGH", "UnitPrice is negative in %s rows. Prices must be >= 0.",
                     (low,), f"{low} > 0", low),
             Outcome("WARNING", "LOW", "UnitPrice is zero in %s rows. This may indicate free items or missing data.",
                     (free,), f"{free} > 0", free),
             Outcome("PASS", "INFO", "All UnitPrice values are > 0."))
    if table.has("Quantity", "InvoiceNo"):
        zero = n["quantity_zero"]
        rule("quantity_zero",
             Outcome("FAIL", "MEDIUM", "Quantity is zero in %s rows. Transactions must have non-zero quantity.",
                     (zero,), f"{zero} > 0", zero),
             Outcome("PASS", "INFO", "No zero-quantity rows found."))
        sales, cancels, adjusted = n["negative_sale"], n["positive_cancellation"], n["adjustment"]
        invalid = f"({sales} + {cancels})"
        rule("quantity_cancellation_logic",
             Outcome("FAIL", "HIGH", "Found %s negative quantities without 'C' invoice prefix, and %s 'C' invoices "
                     "without negative quantity.", (sales, cancels), f"{invalid} > 0", invalid),
             Outcome("WARNING", "MEDIUM", "Found %s negative, zero-price rows without a 'C' invoice prefix. They "
                     "match an administrative-adjustment pattern and should be investigated.",
                     (adjusted,), f"{adjusted} > 0", adjusted,
                     metadata={"administrative_adjustment_rows": adjusted}),
             Outcome("PASS", "INFO", "Cancellation logic is consistent. Found %s valid cancellations.",
                     (n["cancelled"],), metadata={"valid_cancellations": n["cancelled"]}))
    if table.has("InvoiceDate"):
        bad = n["bad_date"]
        rule("invoice_date_validity",
             Outcome("FAIL", "HIGH", "Failed to parse %s InvoiceDate values as datetimes.",
                     (bad,), f"{bad} > 0", bad),
             Outcome("PASS", "INFO", "All InvoiceDate values parsed successfully."))
    return out


VALIDITY = Check("ValidityCheck", "validity", _validity_predicates, _validity_findings)


# Uniqueness --------------------------------------------------------------------------------------

def _repeat_findings(table: Table, n: Counts) -> list[Finding]:
    return [Finding("duplicate_rows", "uniqueness", (
        Outcome("PASS", "INFO", "No duplicate rows found.", when=f"{n.repeats} = 0"),
        Outcome("WARNING", "MEDIUM", "Found %s exact duplicate rows (%s%%).",
                (n.repeats, share_of_rows(n.repeats)), rows=n.repeats),
    ), given=f"{n.rows} > 0")]


UNIQUENESS = Check("UniquenessCheck", "uniqueness", findings=_repeat_findings, needs_repeats=True)


def default_checks(settings: Settings | None = None) -> list[Check]:
    """The registered checks, in report order."""
    return [schema_check(settings=settings), COMPLETENESS, VALIDITY, UNIQUENESS]
