"""Views that give the operators their input shapes, derived from the given tables."""

from lodestrata.plans.base import VIEWS

VIEWS["checks"] = """
SELECT event_id, 'provider' || CAST(user_id % 7 AS STRING) AS provider, ts, value AS latency_ms,
       CAST(150 + (event_id * 37) % 420 AS INT) AS status_code,
       CASE event_id % 7 WHEN 0 THEN 'getaddrinfo ENOTFOUND host' WHEN 1 THEN 'connect ECONNREFUSED 10.0.0.1'
            WHEN 2 THEN 'Request Timeout' WHEN 3 THEN 'self-signed Certificate' WHEN 4 THEN 'security_exception'
            WHEN 5 THEN 'PKIX path building failed' ELSE 'boom ' || event_type END AS message
FROM <<events>>"""

VIEWS["string_log"] = """
SELECT event_id AS seq, ts, 'u' || CAST(user_id AS STRING) AS key,
       CASE event_type WHEN 'view' THEN 'SETEX' WHEN 'signup' THEN 'SET' WHEN 'click' THEN 'EXPIRE'
            WHEN 'purchase' THEN 'PERSIST' ELSE CASE WHEN event_id % 3 = 0 THEN 'DEL' ELSE 'EXPIRE' END END AS op,
       'v' || CAST(event_id AS STRING) AS value,
       CASE WHEN event_type = 'signup' OR event_type = 'purchase' THEN NULL
            ELSE CAST(3600 * (1 + event_id % 96) AS BIGINT) END AS ttl
FROM <<events>>"""

VIEWS["hash_log"] = """
SELECT event_id AS seq, ts, 'h' || CAST(user_id % 50 AS STRING) AS key, event_type || CAST(event_id % 5 AS STRING) AS field,
       CASE WHEN value > 60 THEN 'HDEL' ELSE 'HSET' END AS op, 'v' || CAST(event_id AS STRING) AS value
FROM <<events>>"""

VIEWS["list_log"] = """
SELECT event_id AS seq, ts, 'l' || CAST(user_id AS STRING) AS key,
       CASE event_type WHEN 'view' THEN 'LPUSH' WHEN 'click' THEN 'RPUSH' WHEN 'signup' THEN 'LPOP'
            WHEN 'purchase' THEN 'RPOP' ELSE CASE WHEN event_id % 2 = 0 THEN 'LPUSH' ELSE 'RPOP' END END AS op,
       'v' || CAST(event_id AS STRING) AS value
FROM <<events>>"""

VIEWS["counter_log"] = """
SELECT event_id AS seq, ts, 'c' || CAST(user_id AS STRING) AS key,
       CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'INCRBY' ELSE 'DECRBY' END AS op,
       CAST(1 + event_id % 9 AS BIGINT) AS amount
FROM <<events>>"""

# Layers of one document per part: scalars over maps, maps over scalars, empty maps, explicit nulls.
VIEWS["layers_text"] = """
SELECT p_partkey AS doc_id, 0 AS layer, 'name' AS path, p_name AS value, 'string' AS vtype FROM <<part>>
UNION ALL SELECT p_partkey, 0, 'brand', p_brand, 'string' FROM <<part>>
UNION ALL SELECT p_partkey, 0, 'meta.type', p_type, 'string' FROM <<part>>
UNION ALL SELECT p_partkey, 0, 'meta.dim.size', CAST(p_size AS STRING), 'number' FROM <<part>>
UNION ALL SELECT p_partkey, 1, 'meta', 'flat', 'string' FROM <<part>> WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 1, 'meta.type', 'X' || p_type, 'string' FROM <<part>> WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, 1, 'tags', '{}', 'map' FROM <<part>> WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 1, 'list', '[1,2]', 'list' FROM <<part>> WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 2, 'meta.extra', p_brand, 'string' FROM <<part>> WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 2, 'name.first', p_name, 'string' FROM <<part>> WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, 2, 'brand', NULL, 'null' FROM <<part>> WHERE p_partkey % 11 = 0
UNION ALL SELECT p_partkey, 2, 'list', '[3]', 'list' FROM <<part>> WHERE p_partkey % 8 = 0
UNION ALL SELECT p_partkey, 2, 'meta', '{}', 'map' FROM <<part>> WHERE p_partkey % 13 = 0
UNION ALL SELECT p_partkey, 2, 'tags.top', p_type, 'string' FROM <<part>> WHERE p_partkey % 10 = 0
"""

VIEWS["contexts"] = """
SELECT c_custkey, c_name, c_mktsegment, c_nationkey,
       '{"user":{"name":"' || c_name || '","tags":["' || c_mktsegment || '","x"]},"seg":"' || c_mktsegment
       || '","nation":' || CAST(c_nationkey AS STRING) || ',"flag":true,"ref":"$.seg"}' AS context,
       'Hi ' || c_name || ' {{ user.name }} from {{city|"nowhere"}}{{empty|""}} $.user.tags[0] {{gone}} ' || chr(92) || '{{raw $.seg {{ref}} {{nation}}{{flag}} {{ ref }}' AS template
FROM <<customer>>"""

VIEWS["variables"] = """
SELECT 'V_' || CAST(s_suppkey % 40 AS STRING) AS key, CASE WHEN MAX(s_suppkey) % 5 = 0 THEN '' ELSE MAX(s_name) END AS value
FROM <<supplier>> WHERE s_suppkey % 3 <> 0 GROUP BY 'V_' || CAST(s_suppkey % 40 AS STRING)"""

VIEWS["credentials"] = """
SELECT c_custkey AS id,
       CASE c_custkey % 6 WHEN 0 THEN 'basic' WHEN 1 THEN 'basic_email_token' WHEN 2 THEN 'bearer'
            WHEN 3 THEN 'custom' WHEN 4 THEN 'edgegrid' ELSE 'none' END AS type,
       CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS username, CASE WHEN c_custkey % 5 <> 0 THEN 'pw' END AS password,
       CASE WHEN c_custkey % 7 <> 0 THEN 'e@x.io' ELSE '' END AS email, CASE WHEN c_custkey % 3 <> 0 THEN 'tok' END AS token
FROM <<customer>>"""

# Folds of one text per customer: an outer fold per slot, some inside others, never half over another.
VIEWS["folds"] = """
SELECT CAST(o_custkey AS STRING) AS path, o_orderkey AS fold_id,
       CAST((o_orderkey % 20) * 100 + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END AS BIGINT) AS start,
       CAST((o_orderkey % 20) * 100 + CASE WHEN o_orderkey % 3 = 0 THEN 40 ELSE 50 + o_orderkey % 40 END AS BIGINT) AS stop,
       CASE o_orderkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'doc' WHEN 2 THEN 'import' WHEN 3 THEN 'class' ELSE 'array' END AS fold_type,
       CAST(1 + o_orderkey % 6 AS BIGINT) AS line_count, o_orderpriority AS preview,
       CASE o_orderkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'typescript' END AS language
FROM <<orders>>"""

VIEWS["fold_files"] = """
SELECT CAST(c_custkey AS STRING) AS path, repeat(c_name || '-', 110) AS content,
       CASE c_custkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'typescript' END AS language,
       CAST(c_custkey % 90 AS BIGINT) AS line_count
FROM <<customer>>"""

# One Python file per part. The first p_partkey % 3 lines are comments.
VIEWS["py_files"] = """
SELECT p_partkey AS n, 'packages_py/pkg-' || CAST(p_partkey % 50 AS STRING) || '/src/mod_' || CAST(p_partkey AS STRING) || '.py' AS path,
       'python' AS language, CAST(p_partkey % 3 AS INT) AS off,
       repeat('# note\n', CAST(p_partkey % 3 AS INT)) ||
       '\"\"\"Module ' || p_name || '.\"\"\"\n' ||
       'import os, sys as system\n' ||
       'import lib_' || CAST(p_partkey % 9 AS STRING) || '.core\n' ||
       '# comment\n' ||
       'from .local_' || CAST(p_partkey % 4 AS STRING) || ' import alpha, beta as b2\n' ||
       'from pkg_' || CAST(p_partkey % 50 AS STRING) || ' import (\n' ||
       '    gamma,\n' ||
       '    delta,\n' ||
       ')\n' ||
       '\n' ||
       'MAX_' || CAST(p_size AS STRING) || ': int = ' || CAST(p_size AS STRING) || '\n' ||
       '__all__ = ["Item' || CAST(p_partkey AS STRING) || '", "run_' || CAST(p_partkey AS STRING) || '"]\n' ||
       '\n' ||
       '@dataclass\n' ||
       'class Item' || CAST(p_partkey AS STRING) || '(BaseModel, ABC):\n' ||
       '    size: int = ' || CAST(p_size AS STRING) || '\n' ||
       '    _instance = None\n' ||
       '\n' ||
       '    @app.get("/x")\n' ||
       '    def get_instance(self, a: int, b=(' || CAST(p_size AS STRING) || ', 1), *args):\n' ||
       '        if a < ' || CAST(p_size AS STRING) || ':\n' ||
       '            raise ValueError("too small ' || CAST(p_size AS STRING) || '")\n' ||
       '        return a\n' ||
       '\n' ||
       '    async def save_json(self):\n' ||
       '        for x in self.items:\n' ||
       '            yield x\n' ||
       '\n' ||
       'class Bad' || CAST(p_partkey AS STRING) || 'Error(ValueError):\n' ||
       '    pass\n' ||
       '\n' ||
       'def run_' || CAST(p_partkey AS STRING) || '(x: str, y: dict[str, int] = None) -> int:\n' ||
       '    if x is None:\n' ||
       '\n' ||
       '        raise RuntimeError("none")\n' ||
       '    return 0\n' ||
       '\n' ||
       'def _hidden_' || CAST(p_partkey AS STRING) || '():\n' ||
       '    return 1\n' AS content
FROM <<part>>"""

# One script file per customer. Odd customers have a comment line first.
VIEWS["js_files"] = """
SELECT c_custkey AS n, 'packages_mjs/app-' || CAST(c_custkey % 40 AS STRING) || '/src/view_' || CAST(c_custkey AS STRING)
       || CASE c_custkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '.mjs' END AS path,
       CASE c_custkey % 3 WHEN 1 THEN 'typescript' ELSE 'javascript' END AS language, CAST(c_custkey % 2 AS INT) AS off,
       repeat('// note\n', CAST(c_custkey % 2 AS INT)) ||
       'import React, { useState, useMemo as um } from ''react'';\n' ||
       'import * as util from ''./util_' || CAST(c_custkey % 5 AS STRING) || ''';\n' ||
       'import ''side-effects'';\n' ||
       'const { readFile, join: j } = require(''fs'');\n' ||
       'const ext = require(''lib-' || CAST(c_custkey % 9 AS STRING) || ''');\n' ||
       'export { helper as h } from ''@scope/pkg' || CAST(c_custkey % 3 AS STRING) || ''';\n' ||
       '\n' ||
       'export const LIMIT_' || CAST(c_custkey % 10 AS STRING) || ' = ' || CAST(c_custkey AS STRING) || ';\n' ||
       'export class View' || CAST(c_custkey AS STRING) || ' extends Base.Widget {\n' ||
       '  static instance = null;\n' ||
       '  count: number = ' || CAST(c_custkey AS STRING) || ';\n' ||
       '  constructor(a) {\n' ||
       '    this.a = a;\n' ||
       '  }\n' ||
       '  static getInstance() {\n' ||
       '    return View.instance;\n' ||
       '  }\n' ||
       '  async loadData(id, opts = {}) {\n' ||
       '    if (id === undefined) {\n' ||
       '      throw new TypeError("id is required");\n' ||
       '    }\n' ||
       '    return id;\n' ||
       '  }\n' ||
       '}\n' ||
       'class My' || CAST(c_custkey AS STRING) || 'Error extends Error {\n' ||
       '}\n' ||
       'export function run' || CAST(c_custkey AS STRING) || '(x, ...rest) {\n' ||
       '  return x;\n' ||
       '}\n' ||
       'const arrow' || CAST(c_custkey AS STRING) || ' = async (p, [q], { r }) => {\n' ||
       '  return import(''lazy-' || CAST(c_custkey % 4 AS STRING) || ''');\n' ||
       '};\n' ||
       'export { arrow' || CAST(c_custkey AS STRING) || ' as main, LIMIT_' || CAST(c_custkey % 10 AS STRING) || ' };\n' AS content
FROM <<customer>>"""

VIEWS["code_files"] = """
SELECT path, language, content FROM <<py_files>> UNION ALL SELECT path, language, content FROM <<js_files>>"""

# The same kinds of code as a formatter leaves them: headers over several lines, code in strings and comments, deep brackets.
VIEWS["formatted_py"] = """
SELECT p_partkey AS n, p_size AS size, 'packages_py/fmt-' || CAST(p_partkey % 50 AS STRING) || '/mod_' || CAST(p_partkey AS STRING) || '.py' AS path,
       'python' AS language,
       '\"\"\"Module.\nimport not_this\ndef nor_this():\n\"\"\"\n' ||
       'import os\n\n\n' ||
       'class Item' || CAST(p_partkey AS STRING) || '(\n' ||
       '    Base,  # the ( base\n' ||
       '    metaclass=Meta,\n' ||
       '):\n' ||
       '    size: int = ' || CAST(p_size AS STRING) || '\n\n' ||
       '    @cached\n' ||
       '    async def load(\n' ||
       '        self,\n' ||
       '        key: str = "a,b:(c",\n' ||
       '        depth=' || repeat('(', 30) || CAST(p_size AS STRING) || ',' || repeat(')', 30) || ',\n' ||
       '    ) -> dict[str, int]:\n' ||
       '        text = "if x: raise No(1)"\n' ||
       '        if (\n' ||
       '            key is None\n' ||
       '            and depth\n' ||
       '        ):\n' ||
       '            log(key)\n' ||
       '            raise ValueError(\n' ||
       '                "no key ' || CAST(p_size AS STRING) || '"\n' ||
       '            )\n' ||
       '        elif key: raise KeyError\n' ||
       '        return {\n' ||
       '  "a": 1,\n' ||
       '        }\n\n' ||
       'def last(): return 1\n' AS content
FROM <<part>>"""

VIEWS["formatted_js"] = """
SELECT c_custkey AS n, 'packages_mjs/fmt-' || CAST(c_custkey % 40 AS STRING) || '/view_' || CAST(c_custkey AS STRING) || '.ts' AS path,
       'typescript' AS language,
       '/* class No {\n function nor() { */\n' ||
       'export class View' || CAST(c_custkey AS STRING) || '\n' ||
       '  extends Base\n' ||
       '{\n' ||
       '  async load(\n' ||
       '    id,\n' ||
       '    opts = { deep: [1, (2)] },\n' ||
       '  ) {\n' ||
       '    const text = `if (x) { throw } function no() {`;\n' ||
       '    if (\n' ||
       '      id === undefined\n' ||
       '    ) {\n' ||
       '      log({ id });\n' ||
       '      throw new TypeError(\n' ||
       '        "id ' || CAST(c_custkey AS STRING) || '"\n' ||
       '      );\n' ||
       '    } else if (opts) throw new RangeError("opts")\n' ||
       '    return items.map((i) => {\n' ||
       '      return i;\n' ||
       '    });\n' ||
       '  }\n' ||
       '}\n' ||
       'function last' || CAST(c_custkey AS STRING) || '(a, [b]) { return 1 }\n' AS content
FROM <<customer>>"""

VIEWS["formatted_files"] = """
SELECT path, language, content FROM <<formatted_py>> UNION ALL SELECT path, language, content FROM <<formatted_js>>"""

VIEWS["manifest_files"] = """
SELECT s_suppkey AS manifest_ord, CASE WHEN s_suppkey % 2 = 0 THEN 'packages_mjs/app-' || CAST(s_suppkey AS STRING) || '/package.json'
       ELSE 'packages_py/pkg-' || CAST(s_suppkey AS STRING) || '/pyproject.toml' END AS path,
       CASE WHEN s_suppkey % 2 = 0 THEN
       '{"name":"app-' || CAST(s_suppkey AS STRING) || '","version":"1.' || CAST(s_nationkey AS STRING)
       || '.0","dependencies":{"react":"^' || CAST(s_suppkey % 4 AS STRING) || '.0","core":"workspace:*"},"devDependencies":{"lib-'
       || CAST(s_suppkey % 9 AS STRING) || '":"~' || CAST(s_suppkey AS STRING) || '"}}'
       ELSE
       '[project]\nname = "pkg-' || CAST(s_suppkey AS STRING) || '"\nversion = "2.' || CAST(s_nationkey AS STRING)
       || '"\ndescription = ''' || s_name || '''\n\n[tool.poetry.dependencies]\nlib_' || CAST(s_suppkey % 9 AS STRING)
       || ' = "^' || CAST(s_suppkey AS STRING) || '"\nlocal = {path = "../x"}\n\n[tool.poetry.dev-dependencies]\n# none\npytest = "'
       || CAST(s_suppkey % 6 AS STRING) || '"\n' END AS content
FROM <<supplier>>"""
