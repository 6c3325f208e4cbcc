"""What the domain tables are bound to, so that every query runs on the driver's tables and SQL can
check it: columns as expressions that Spark and ANSI SQL read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

FINDINGS = {
    "scan_id": "l_orderkey",
    "finding_id": "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000",
    "title": "concat('Finding number ', cast(l_partkey % 97 as string), ' in module ', cast(l_suppkey % 7 as string))",
    "severity": "case when l_quantity > 45 then 'critical' when l_quantity > 35 then 'high' when l_quantity > 20 then 'medium' when l_quantity > 8 then 'low' when l_quantity > 2 then 'info' else 'odd' end",
    "confidence": "cast(1.0 - l_discount * 5 as double)",
    "status": "case when l_linenumber = 3 then 'dismissed' when l_linenumber = 2 then 'candidate' else 'confirmed' end",
    "category": "case l_partkey % 14 when 0 then 'auth' when 1 then 'crypto' when 2 then 'injection' when 3 then 'xss' when 4 then 'file_handling' when 5 then 'command_exec' when 6 then 'deserialization' when 7 then 'ssrf' when 8 then ' Config ' when 9 then 'api' when 10 then 'race_condition' when 11 then '' when 12 then 'logging' end",
    "exploit_difficulty": "case l_returnflag when 'A' then 'easy' when 'N' then 'moderate' else 'hard' end",
    "provenance": "case when l_linestatus = 'O' then 'llm' else 'scanner' end",
    "file_path": "concat('src/', case l_suppkey % 5 when 0 then 'api' when 1 then 'api2' when 2 then 'core/db' when 3 then 'web' else 'tests' end, '/f', cast(l_partkey % 50 as string), '.py')",
    "cwe": "case l_partkey % 9 when 0 then 'CWE-89' when 1 then 'CWE-79' when 2 then 'CWE-798' when 3 then 'CWE-22' when 4 then 'CWE-918' when 5 then 'CWE-502' when 6 then 'CWE-99999' end",
    "start_line": "cast(l_partkey % 200 + 1 as int)",
    "end_line": "cast(l_partkey % 200 + 1 + l_linenumber as int)",
}
FILES = {
    "file_id": "p_partkey",
    "path": "concat(case p_partkey % 20 when 0 then 'src/auth/login_' when 1 then './src/api/user_controller' when 2 then 'tests/test_thing' when 3 then 'node_modules/left/index.min' when 4 then 'docs/Readme' when 5 then 'app/AndroidManifest' when 6 then 'vendor/lib/dist/a' when 7 then '/srv/config/.env' when 8 then concat('win', chr(92), 'Sub', chr(92), 'helper') when 9 then 'Dockerfile' when 10 then '../up/' when 11 then 'a/./b/../../../x' when 12 then 'pkg/sql_query.d' when 13 then 'gen/model.g' when 14 then 'web/__tests__/view.spec' when 15 then 'CHANGELOG' when 16 then 'src/payment/checkout' when 17 then '.env.example' when 18 then 'x/.gitignore' else 'plain' end, case when p_partkey % 20 in (9, 15, 17, 18) then '' else concat(case when p_partkey % 3 = 0 then cast(p_partkey as string) else '' end, case p_partkey % 7 when 0 then '.py' when 1 then '.JS' when 2 then '.md' when 3 then '.yaml' when 4 then '.png' when 5 then '.ts' else '' end) end)",
    "line_count": "cast(p_partkey % 11 * p_size * 5 as int)",
    "hits": "cast(p_partkey % 9 as int)",
}
DEPENDENCIES = {
    "id": "p_partkey",
    "ecosystem": "case p_partkey % 4 when 0 then 'pypi' when 1 then 'npm' when 2 then 'maven' else 'hex' end",
    "name": "case p_partkey % 4 when 2 then concat('Org.Acme : lib-', cast(p_partkey % 60 as string)) when 3 then concat('my.pkg-', cast(p_partkey % 60 as string)) when 0 then concat(' My__Pkg.', cast(p_partkey % 60 as string), ' ') else concat('Left-Pad', cast(p_partkey % 60 as string)) end",
    "version": "concat(case p_partkey % 6 when 0 then '^' when 1 then '>= ' when 2 then 'v' when 3 then 'npm:x@' when 4 then 'file:' else '' end, cast(p_size % 5 as string), '.', cast(p_size % 7 as string), '.0', case when p_partkey % 10 = 0 then ' || 9.0.0' else '' end)",
    "is_dev": "p_partkey % 5 = 0",
    "severity": "case p_partkey % 6 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'info' end",
    "cvss_score": "case when p_partkey % 3 = 0 then cast(p_size % 11 as double) end",
    "fixed_version": "case when p_partkey % 2 = 0 then '2.0.0' else '' end",
    "source_file": "concat('m', cast(p_partkey % 3 as string), '/package.json')",
}
_NODE = "(l_suppkey * 31 + l_partkey) % 997"
EDGES = {"edge_id": "l_orderkey * 10 + l_linenumber", "caller": f"concat('f', cast({_NODE} as string))", "callee": f"concat('f', cast({_NODE} + 1 + l_linenumber % 3 as string))"}


def select(binding: dict) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in binding.items())


def source(binding: dict) -> str:
    return {id(FINDINGS): "lineitem", id(EDGES): "lineitem", id(FILES): "part", id(DEPENDENCIES): "part"}[id(binding)]


def sql(binding: dict, where: str = "") -> str:
    """A subquery of the binding."""
    return f"(SELECT {select(binding)} FROM {source(binding)}{' WHERE ' + where if where else ''})"


def frame(spark: SparkSession, sf_dir: str, binding: dict, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, source(binding)).where(where).selectExpr(*[f"{e} AS {n}" for n, e in binding.items()])
