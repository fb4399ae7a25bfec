"""The detectors as data: what each looks for, and what is known about it.

Everything else is derived from this list: the scan, the registry of gaps, the verification
modes, the hints and the messages.  Messages and hints are keyed by language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from quillspark.functions.phrases import ID, named, phrase, words


@dataclass(frozen=True)
class Part:
    """One pattern of a detector.

    shape: scan (anywhere, named by the object around it), declare (a declaration, named by
    itself), statement (probes in a declaration's statement), columns (probes in a table's
    column list), or the name of an operator of its own.  take: which probes count (all, first,
    exists, none).  at: the place reported (hit, start, name).  snippet: match, collapse, upper
    (group 1), or a text in which {} stands for group 1 in upper case.
    """

    shape: str
    pattern: str = ""
    probe: str = ""
    take: str = "all"
    at: str = "hit"
    snippet: str = "match"
    ends: bool = True
    near: tuple[str, ...] = ()
    view: str = "clean"
    message: int = 0


@dataclass(frozen=True)
class Spec:
    name: str
    parts: tuple[Part, ...]
    messages: tuple[str, ...]
    hint: str
    gap: str | None = None
    slug: str = ""
    stage: str | None = None
    mode: str = "not_verifiable"
    severity: str = "high"
    tests: tuple[str, ...] = field(default=())

    @property
    def test_files(self) -> tuple[str, ...]:
        return self.tests or (f"test_{self.name}.py",)


_TYPE = "CREATE [OR REPLACE] [EDITIONABLE|NONEDITIONABLE] TYPE"
_TABLE = named("CREATE TABLE")
_BEFORE, _AFTER = '(?<!")', '(?!")'
SCALARS = "NUMBER VARCHAR2 VARCHAR INTEGER PLS_INTEGER BINARY_INTEGER BOOLEAN DATE TIMESTAMP CHAR NCHAR CLOB RAW LONG".split()
STATE = rf"(?m)^[ \t]*({ID})\s+(?:CONSTANT\s+)?(?:(?:{'|'.join(SCALARS)})(?:\s*\([^)]*\))?|{ID}(?:\.{ID})?%TYPE)\s*(?:NOT\s+NULL\s*)?(?::=|DEFAULT\b|;)"
CALLS_CONVERTED = tuple(f"DBMS_{x}" for x in ("OUTPUT.PUT_LINE", "OUTPUT.PUT", "OUTPUT.NEW_LINE", "OUTPUT.ENABLE", "OUTPUT.DISABLE", "LOB.GETLENGTH", "LOB.SUBSTR"))


def _scan(pattern: str, snippet: str = "match", view: str = "visible", **more) -> Part:
    return Part("scan", pattern, snippet=snippet, view=view, **more)


def _table(probe: str, snippet: str, take: str = "all", **more) -> Part:
    return Part("statement", _TABLE, probe, take, snippet=snippet, **more)


SPECS: tuple[Spec, ...] = (
    Spec("autonomous_tx", (Part("blocks"),), ("An autonomous transaction commits apart from its caller; the conversion opens a second session for it, and the cost estimate leaves that work out.",), "Move the logging or audit write to a separate connection, or accept that it joins the caller's transaction.", "001", "autonomous-transaction", tests=("test_autonomous_tx.py", "test_autonomous_tx_edge_cases.py")),
    Spec("compound_triggers", (Part("statement", named("CREATE [OR REPLACE] [EDITIONABLE|NONEDITIONABLE] TRIGGER"), words("COMPOUND TRIGGER"), "first", ends=False),), ("A compound trigger's timing sections share state; no single trigger of PostgreSQL does.",), "Split it into one trigger for each timing point and keep shared state in a temporary table.", "004", "compound-trigger", "semantic"),
    Spec("dbms_utl_calls", (Part("calls", rf"(?<![A-Z0-9_$#])(?:DBMS|UTL)_[A-Z0-9_$#]*\.{ID}"),), ("A call of a supplied package that the conversion leaves as it is.",), "Replace the call by an extension, a function of your own, or application code.", mode="verbatim", severity="medium"),
    Spec("merge_delete_clause", (Part("merge", words("MERGE INTO"), words("DELETE WHERE"), view="visible"),), ("MERGE with DELETE WHERE is left as it is and is not valid.",), "Write the deletion as a WHEN MATCHED AND ... THEN DELETE branch or as a statement of its own.", "002", "merge-delete-clause", "runtime", "verbatim"),
    Spec(
        "bulk_collect",
        (Part("local_type", rf"\bTYPE\s+{ID}\s+IS\s+TABLE\s+OF\b", phrase(f"{_TYPE}")[: -len("TYPE")], view="visible"), _scan(words("BULK COLLECT INTO"), message=1), _scan(words("FORALL"), message=2)),
        ("A collection type of a block is left as it is; PL/pgSQL has none.", "BULK COLLECT INTO is left as it is and does not parse.", "FORALL is left as it is and does not parse."),
        "Use arrays with array_agg, or one set-based statement in place of the loop.",
        "003",
        "bulk-collect-forall",
        "runtime",
        "verbatim",
    ),
    Spec("database_link", (_scan(rf"\b{ID}@{ID}(?:\.{ID})*", view="unquoted"),), ("A name behind a database link is left as it is.",), "Set up a foreign data wrapper and name its foreign table.", "006", "database-link", "runtime", "verbatim"),
    Spec("model_clause", (_scan(words("MODEL"), "MODEL", near=(words("MEASURES"), words("RULES"))),), ("The MODEL clause is left as it is; PostgreSQL has none.",), "Rewrite the rules with window functions or a recursive query.", "007", "model-clause", "runtime", "verbatim"),
    Spec("pivot_clause", (_scan(rf"\b(PIVOT|UNPIVOT)\b\s*(?:XML\s+|(?:IN|EX)CLUDE\s+NULLS\s+)?\(", "{}"),), ("PIVOT and UNPIVOT are left as they are.",), "Use conditional aggregates, crosstab, or a lateral VALUES list.", "008", "pivot-unpivot", "runtime", "verbatim"),
    Spec("object_type", (Part("declare", named(_TYPE) + r"\s+(?:IS|AS)\s+OBJECT\b", at="start", snippet="CREATE TYPE ... AS OBJECT"), Part("declare", named(f"{_TYPE} BODY"), at="start", snippet="CREATE TYPE BODY")), ("Object types have no place in the cost estimate, and their methods are not converted.",), "Use a composite type and plain functions.", "009", "object-type", mode="verbatim"),
    Spec("with_function", (_scan(words("WITH {FUNCTION|PROCEDURE}"), "collapse"),), ("A routine declared in a WITH clause is not converted.",), "Create the routine on its own.", "010", "with-function", "runtime"),
    Spec("flashback_query", (_scan(words("AS OF {TIMESTAMP|SCN}"), "collapse"),), ("A flashback query is left as it is.",), "Keep history in a table with validity times.", "011", "flashback-query", "runtime", "verbatim"),
    Spec("global_temp_table", (Part("statement", named("CREATE GLOBAL TEMPORARY TABLE"), words("ON COMMIT PRESERVE ROWS"), "none", "start", "CREATE GLOBAL TEMPORARY TABLE"),), ("Without ON COMMIT PRESERVE ROWS the rows go at commit; after conversion they stay.",), "Add ON COMMIT DELETE ROWS.", "012", "global-temp-table", "semantic"),
    Spec("table_partitioning", (_table(rf"\bPARTITION\s+BY\s+(?:(RANGE|LIST|HASH|REFERENCE)\s*\(|(SYSTEM)\s*(?:\(|PARTITIONS\b))", "PARTITION BY {}"),), ("The partitioning of the table is dropped.",), "Declare the partitions in PostgreSQL's own syntax.", "013", "table-partitioning", "semantic"),
    Spec("connect_by_nocycle", (_scan(words("CONNECT BY NOCYCLE"), "CONNECT BY NOCYCLE"), _scan(words("ORDER SIBLINGS BY"), "ORDER SIBLINGS BY")), ("NOCYCLE and ORDER SIBLINGS BY give a query that is rejected.",), "Use a recursive query with a CYCLE or SEARCH clause.", "014", "connect-by-nocycle", "deployment"),
    Spec("context_object", (Part("declare", named("CREATE [OR REPLACE] CONTEXT"), at="start", snippet="CREATE CONTEXT"),), ("An application context is dropped.",), "Use session settings with set_config and current_setting.", "015", "context", "semantic", severity="medium"),
    Spec("insert_all", (_scan(words("INSERT {ALL|FIRST}"), "INSERT {}", near=(words("INTO"),)),), ("A multi-table insert is left as it is.",), "Write one INSERT for each table over a shared common table expression.", "016", "insert-all", "runtime", "verbatim"),
    Spec("json_table", (_scan(rf"\bJSON_TABLE\s*\(", "JSON_TABLE(...)"),), ("JSON_TABLE is left as it is and is unknown before version 17.",), "Use jsonb_to_recordset or jsonb_path_query.", "017", "json-table", "runtime", "verbatim"),
    Spec("external_table", (_table(words("ORGANIZATION EXTERNAL"), "ORGANIZATION EXTERNAL", "exists", at="start"),), ("An external table becomes an ordinary, empty one.",), "Use a foreign table over the file.", "018", "external-table", "semantic"),
    Spec("sql_macro", (_scan(words("SQL_MACRO"), "SQL_MACRO"),), ("A SQL macro becomes a function that returns text.",), "Write the macro's query as a view or a set-returning function.", "019", "sql-macro", "runtime"),
    Spec("invisible_column", (_table(rf"\bINVISIBLE\b(?=\s*(?:[,)]|(?:{'|'.join('NOT DEFAULT ENCRYPT UNIQUE PRIMARY CONSTRAINT REFERENCES CHECK'.split())})\b))", "INVISIBLE"),), ("An invisible column becomes a visible one.",), "Select columns by name, or hide the column behind a view.", "020", "invisible-column", "semantic"),
    Spec("collection_type", (Part("declare", named(_TYPE) + r"\s+(?:IS|AS)\s+(?:TABLE\s+OF\b|VAR(?:RAY|YING\s+ARRAY)\s*\(\s*\d+\s*\)\s*OF\b)", at="start", snippet="CREATE TYPE ... TABLE OF / VARRAY OF"),), ("A collection type gives a statement that is rejected.",), "Use an array of the element type.", "021", "collection-type", "deployment"),
    Spec("cross_apply", (_scan(words("{CROSS|OUTER} APPLY"), "{} APPLY"),), ("CROSS APPLY and OUTER APPLY are left as they are.",), "Use a lateral join.", "022", "cross-apply", "runtime", "verbatim"),
    Spec("oracle_text", (Part("statement", named("CREATE INDEX"), words(r"INDEXTYPE IS CTXSYS\.(CONTEXT|CTXCAT|CTXRULE)"), "first", snippet="INDEXTYPE IS CTXSYS.{}"), Part("text_call", rf"\b(CONTAINS|CATSEARCH|MATCHES)\s*\(", view="visible", snippet="{}(...)")), ("A text index or text query has no counterpart in the result.",), "Use tsvector columns with a GIN index.", "023", "oracle-text", "runtime"),
    Spec("recursive_with", (Part("chains"),), ("A common table expression that refers to itself comes out without RECURSIVE.",), "Add RECURSIVE.", "024", "recursive-with", "runtime", "verbatim"),
    Spec("invisible_index", (Part("statement", named("CREATE [UNIQUE|BITMAP] INDEX"), rf"{_BEFORE}\bINVISIBLE\b{_AFTER}(?!\s*[,)])", "first", snippet="INVISIBLE"),), ("An invisible index becomes one that the planner uses.",), "Leave the index out.", "025", "invisible-index", "semantic", severity="medium"),
    Spec("read_only_table", (_table(_BEFORE + words("READ ONLY") + _AFTER, "READ ONLY", "first"),), ("READ ONLY is dropped and the table can be written.",), "Revoke the writing privileges, or add a trigger that refuses.", "026", "read-only-table", "semantic"),
    Spec("materialized_view_log", (Part("declare", named("CREATE MATERIALIZED VIEW LOG ON"), at="start", snippet="CREATE MATERIALIZED VIEW LOG"),), ("The log is dropped, and with it fast refresh.",), "Refresh in full, or keep the summary by triggers.", "027", "materialized-view-log", "semantic"),
    Spec("identity_column", (_table(rf"\bGENERATED\s+(?:ALWAYS|BY\s+DEFAULT(?:\s+ON\s+NULL)?)\s+AS\s+IDENTITY\s*\(", "GENERATED ... AS IDENTITY (...)"),), ("The options of an identity column give a statement that is rejected.",), "Write the options in PostgreSQL's order and spelling.", "028", "identity-column", "deployment", "verbatim"),
    Spec("default_on_null", (_table(words("DEFAULT ON NULL"), "collapse"),), ("DEFAULT ON NULL gives a statement that is rejected.",), "Use DEFAULT, and a trigger where nulls are sent.", "031", "default-on-null", "deployment", "verbatim"),
    Spec("rowid_type", (Part("columns", _TABLE, rf'(?<![A-Z0-9_$#])"?{ID}"?\s+U?ROWID\b(?:\s*\(\s*\d+\s*\))?', snippet="collapse"),), ("A ROWID column changes to a type that can't hold row addresses.",), "Refer to rows by their keys.", "029", "rowid-urowid", "runtime"),
    Spec("sequence_cycle", (Part("statement", named("CREATE SEQUENCE"), words("CYCLE"), "first", snippet="CYCLE"),), ("CYCLE is dropped, so the sequence fails at its end.",), "Add CYCLE to the sequence.", "030", "sequence-cycle", "runtime"),
    Spec("public_synonym", (Part("statement", named("CREATE [OR REPLACE] [PUBLIC] SYNONYM"), rf"\bFOR\s+" + named("@")[len("@") + len(r"\s+") :], "first", "name", "FOR {}"),), ("A synonym becomes a view, which needs its target to exist and to be a table.",), "Use the search path.", "032", "public-synonym", "deployment"),
    Spec("virtual_column", (Part("columns", _TABLE, rf"\bAS\s*\(", snippet="AS (...)"),), ("A virtual column becomes a plain one kept by a trigger.",), "Use a generated stored column.", "033", "virtual-column", "semantic", severity="medium"),
    Spec("conditional_compilation", (_scan(rf"\$(?:IF|ELSIF|ELSE|END)\b", view="clean"),), ("A conditional compilation directive is left as it is.",), "Keep the branch that holds in the target, and delete the rest.", "035", "conditional-compilation", "runtime", "verbatim"),
    Spec("nested_subprogram", (Part("blocks"),), ("A routine inside a routine is not converted.",), "Make it a routine of its own and hand it what it used.", "034", "nested-subprogram", "runtime"),
    Spec("package_state", (Part("package_state"),), ("A package variable becomes a session setting without a type.",), "Keep the state in a temporary table or in the application.", "036", "package-state", "runtime"),
    Spec("index_organized_table", (_table(_BEFORE + words("ORGANIZATION INDEX") + _AFTER, "ORGANIZATION INDEX", "first"),), ("An index-organized table becomes a heap.",), "Cluster the table on its key.", "037", "index-organized-table", "semantic", severity="medium"),
)
#: Looks at generated code, not at sources, and is asked for.
GENERATED = Spec("connect_by", (Part("generated"),), ("LEVEL is used in a recursive query that doesn't define it.",), "Carry the level as a column of the recursive query.", "005", "connect-by-level", "runtime", "generated_only")
ALL = (*SPECS, GENERATED)
BY_NAME = {s.name: s for s in ALL}
