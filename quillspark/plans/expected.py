"""What is known of each detector, written out: the SQL side of the queries uses these literals, so a change in the list of detectors shows."""

from __future__ import annotations

#: detector: (severity, gap number, slug, failure stage, verification mode, hint, messages)
KNOWN: dict[str, tuple[str, str | None, str, str | None, str, str, tuple[str, ...]]] = {
    'autonomous_tx': ('high', '001', 'autonomous-transaction', None, 'not_verifiable', "Move the logging or audit write to a separate connection, or accept that it joins the caller's transaction.", ('An autonomous transaction commits apart from its caller; the conversion opens a second session for it, and the cost estimate leaves that work out.',)),
    'compound_triggers': ('high', '004', 'compound-trigger', 'semantic', 'not_verifiable', 'Split it into one trigger for each timing point and keep shared state in a temporary table.', ("A compound trigger's timing sections share state; no single trigger of PostgreSQL does.",)),
    "dbms_utl_calls": ("medium", None, "", None, "verbatim", "Replace the call by an extension, a function of your own, or application code.", ("A call of a supplied package that the conversion leaves as it is.",)),
    "merge_delete_clause": ("high", "002", "merge-delete-clause", "runtime", "verbatim", "Write the deletion as a WHEN MATCHED AND ... THEN DELETE branch or as a statement of its own.", ("MERGE with DELETE WHERE is left as it is and is not valid.",)),
    "bulk_collect": ("high", "003", "bulk-collect-forall", "runtime", "verbatim", "Use arrays with array_agg, or one set-based statement in place of the loop.", ("A collection type of a block is left as it is; PL/pgSQL has none.", "BULK COLLECT INTO is left as it is and does not parse.", "FORALL is left as it is and does not parse.")),
    "database_link": ("high", "006", "database-link", "runtime", "verbatim", "Set up a foreign data wrapper and name its foreign table.", ("A name behind a database link is left as it is.",)),
    "model_clause": ("high", "007", "model-clause", "runtime", "verbatim", "Rewrite the rules with window functions or a recursive query.", ("The MODEL clause is left as it is; PostgreSQL has none.",)),
    "pivot_clause": ("high", "008", "pivot-unpivot", "runtime", "verbatim", "Use conditional aggregates, crosstab, or a lateral VALUES list.", ("PIVOT and UNPIVOT are left as they are.",)),
    "object_type": ("high", "009", "object-type", None, "verbatim", "Use a composite type and plain functions.", ("Object types have no place in the cost estimate, and their methods are not converted.",)),
    "with_function": ("high", "010", "with-function", "runtime", "not_verifiable", "Create the routine on its own.", ("A routine declared in a WITH clause is not converted.",)),
    "flashback_query": ("high", "011", "flashback-query", "runtime", "verbatim", "Keep history in a table with validity times.", ("A flashback query is left as it is.",)),
    "global_temp_table": ("high", "012", "global-temp-table", "semantic", "not_verifiable", "Add ON COMMIT DELETE ROWS.", ("Without ON COMMIT PRESERVE ROWS the rows go at commit; after conversion they stay.",)),
    'table_partitioning': ('high', '013', 'table-partitioning', 'semantic', 'not_verifiable', "Declare the partitions in PostgreSQL's own syntax.", ('The partitioning of the table is dropped.',)),
    "connect_by_nocycle": ("high", "014", "connect-by-nocycle", "deployment", "not_verifiable", "Use a recursive query with a CYCLE or SEARCH clause.", ("NOCYCLE and ORDER SIBLINGS BY give a query that is rejected.",)),
    "context_object": ("medium", "015", "context", "semantic", "not_verifiable", "Use session settings with set_config and current_setting.", ("An application context is dropped.",)),
    "insert_all": ("high", "016", "insert-all", "runtime", "verbatim", "Write one INSERT for each table over a shared common table expression.", ("A multi-table insert is left as it is.",)),
    "json_table": ("high", "017", "json-table", "runtime", "verbatim", "Use jsonb_to_recordset or jsonb_path_query.", ("JSON_TABLE is left as it is and is unknown before version 17.",)),
    "external_table": ("high", "018", "external-table", "semantic", "not_verifiable", "Use a foreign table over the file.", ("An external table becomes an ordinary, empty one.",)),
    'sql_macro': ('high', '019', 'sql-macro', 'runtime', 'not_verifiable', "Write the macro's query as a view or a set-returning function.", ('A SQL macro becomes a function that returns text.',)),
    "invisible_column": ("high", "020", "invisible-column", "semantic", "not_verifiable", "Select columns by name, or hide the column behind a view.", ("An invisible column becomes a visible one.",)),
    "collection_type": ("high", "021", "collection-type", "deployment", "not_verifiable", "Use an array of the element type.", ("A collection type gives a statement that is rejected.",)),
    "cross_apply": ("high", "022", "cross-apply", "runtime", "verbatim", "Use a lateral join.", ("CROSS APPLY and OUTER APPLY are left as they are.",)),
    "oracle_text": ("high", "023", "oracle-text", "runtime", "not_verifiable", "Use tsvector columns with a GIN index.", ("A text index or text query has no counterpart in the result.",)),
    "recursive_with": ("high", "024", "recursive-with", "runtime", "verbatim", "Add RECURSIVE.", ("A common table expression that refers to itself comes out without RECURSIVE.",)),
    "invisible_index": ("medium", "025", "invisible-index", "semantic", "not_verifiable", "Leave the index out.", ("An invisible index becomes one that the planner uses.",)),
    "read_only_table": ("high", "026", "read-only-table", "semantic", "not_verifiable", "Revoke the writing privileges, or add a trigger that refuses.", ("READ ONLY is dropped and the table can be written.",)),
    "materialized_view_log": ("high", "027", "materialized-view-log", "semantic", "not_verifiable", "Refresh in full, or keep the summary by triggers.", ("The log is dropped, and with it fast refresh.",)),
    'identity_column': ('high', '028', 'identity-column', 'deployment', 'verbatim', "Write the options in PostgreSQL's order and spelling.", ('The options of an identity column give a statement that is rejected.',)),
    "default_on_null": ("high", "031", "default-on-null", "deployment", "verbatim", "Use DEFAULT, and a trigger where nulls are sent.", ("DEFAULT ON NULL gives a statement that is rejected.",)),
    'rowid_type': ('high', '029', 'rowid-urowid', 'runtime', 'not_verifiable', 'Refer to rows by their keys.', ("A ROWID column changes to a type that can't hold row addresses.",)),
    "sequence_cycle": ("high", "030", "sequence-cycle", "runtime", "not_verifiable", "Add CYCLE to the sequence.", ("CYCLE is dropped, so the sequence fails at its end.",)),
    "public_synonym": ("high", "032", "public-synonym", "deployment", "not_verifiable", "Use the search path.", ("A synonym becomes a view, which needs its target to exist and to be a table.",)),
    "virtual_column": ("medium", "033", "virtual-column", "semantic", "not_verifiable", "Use a generated stored column.", ("A virtual column becomes a plain one kept by a trigger.",)),
    "conditional_compilation": ("high", "035", "conditional-compilation", "runtime", "verbatim", "Keep the branch that holds in the target, and delete the rest.", ("A conditional compilation directive is left as it is.",)),
    "nested_subprogram": ("high", "034", "nested-subprogram", "runtime", "not_verifiable", "Make it a routine of its own and hand it what it used.", ("A routine inside a routine is not converted.",)),
    "package_state": ("high", "036", "package-state", "runtime", "not_verifiable", "Keep the state in a temporary table or in the application.", ("A package variable becomes a session setting without a type.",)),
    "index_organized_table": ("medium", "037", "index-organized-table", "semantic", "not_verifiable", "Cluster the table on its key.", ("An index-organized table becomes a heap.",)),
    'connect_by': ('high', '005', 'connect-by-level', 'runtime', 'generated_only', 'Carry the level as a column of the recursive query.', ("LEVEL is used in a recursive query that doesn't define it.",)),
}
