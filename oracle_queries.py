"""DuckDB statements that state what each registered query must return.

They are written from the rules, not from the Spark plans: searches try every
candidate, sibling flags come from windows, patterns are spelled out by hand.
"""

from __future__ import annotations

from arborlake.plans.catalog import HEAD_BUDGET, NEST_BUDGET, TIGHT_BUDGET, WIDE_BUDGET

NL = "chr(10)"
WS = (
    "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760)"
    " || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198)"
    " || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239)"
    " || chr(8287) || chr(12288)"
)

# -- trees over the driver tables --------------------------------------------

DOC_FIELDS = """
  lang AS corpus_id,
  CASE
    WHEN doc_id % 101 = 0 THEN source || '/.env.' || doc_id
    WHEN doc_id % 97 = 0 THEN '.env.' || doc_id
    WHEN doc_id % 89 = 0 THEN 'id_' || doc_id
    WHEN doc_id % 23 = 0 THEN source || '/' || dir || '/d' || doc_id || '/Dockerfile'
    WHEN doc_id % 29 = 0 THEN source || '/' || dir || '/d' || doc_id || '/LICENSE'
    WHEN doc_id % 31 = 0 THEN source || '/' || dir || '/test_' || doc_id || '.' || ext
    ELSE source || '/' || dir || '/f' || doc_id || '.' || ext
  END AS path
"""
DOC_BASE = """
  SELECT *,
    (['src','src/core','src/util','tests','docs','target/debug','node_modules/pkg','vendor/lib',
      'third_party/dep','.cache','config','build'])[1 + (doc_id + 5 * (doc_id // 20)) % 12] AS dir,
    (['rs','py','md','json','toml','txt','lock','pem','log','tsx','yml','sql','png'])[1 + doc_id % 13] AS ext
  FROM documents
"""
INDENTED = (
    f"array_to_string(list_transform(string_split(text, {NL}),"
    f" lambda x, i: repeat('    ', (i - 1) % 4) || x), {NL})"
)


BLOCKS = (
    f"array_to_string(list_transform(string_split(text, {NL}),"
    f" lambda x, i: repeat(' ', ((i - 1) // 12) % 4) || x), {NL})"
)


def docs(text: str = "text") -> str:
    return (
        f"f AS (SELECT {DOC_FIELDS}, {text} AS content, octet_length(encode({text})) AS size_bytes"
        f" FROM ({DOC_BASE}))"
    )


PAGES = r"""f AS (
  SELECT corpus_id, CASE WHEN turn = 1 THEN path
      ELSE left(path, length(path) - length(ext)) || '~' || CAST(page_id AS VARCHAR) || ext END AS path, size_bytes
  FROM (
    SELECT *, regexp_extract(path, '[^/](\.[^./]*)$', 1) AS ext,
      row_number() OVER (PARTITION BY corpus_id, path ORDER BY page_id) AS turn
    FROM (
      SELECT page_id, corpus_id, size_bytes,
        CASE WHEN rtrim(p, '/') = '' THEN 'index' WHEN rtrim(p, '/') <> p THEN rtrim(p, '/') || '/index' ELSE p END AS path
      FROM (
        SELECT page_id, regexp_extract(coalesce(url, ''), '^https?://([^/?#]+)', 1) AS corpus_id,
          regexp_extract(coalesce(url, ''), '^https?://[^/?#]+/([^?#]*)', 1) AS p,
          octet_length(encode(html)) AS size_bytes
        FROM pages))))"""

NAME = "split_part(path, '/', -1)"


def ext_of(path: str = "path") -> str:
    name = f"split_part({path}, '/', -1)"
    return (
        f"CASE WHEN regexp_matches({name}, '^.+\\.[^.]*$')"
        f" THEN regexp_extract({name}, '^.+\\.([^.]*)$', 1) END"
    )


PARENT = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END"
# Ancestors of every row of a table, top down.
ANCESTORS = """anc AS (
  SELECT corpus_id, path, i, array_to_string(string_split(path, '/')[1:i], '/') AS a
  FROM {src}, UNNEST(range(1, len(string_split(path, '/')))) u(i))"""


def entries(src: str = "f", files: str = "corpus_id, path") -> str:
    return (
        ANCESTORS.format(src=src)
        + f", e AS (SELECT {files}, false AS is_dir FROM {src}"
        " UNION ALL SELECT DISTINCT corpus_id, a, true FROM anc)"
    )


def lines_of(text: str) -> str:
    split = f"string_split({text}, {NL})"
    drop = f"(CASE WHEN {text} = '' OR ends_with({text}, {NL}) THEN 1 ELSE 0 END)"
    return f"{split}[1:len({split}) - {drop}]"


BINARY_EXT = (
    "'exe','dll','so','dylib','a','lib','o','obj','png','jpg','jpeg','gif','bmp','ico','webp','svg',"
    "'pdf','zip','tar','gz','bz2','xz','7z','rar','mp3','mp4','avi','mkv','mov','wav','flac','ttf','otf',"
    "'woff','woff2','eot','db','sqlite','sqlite3','pyc','pyo','class','jar','war','lock','sum'"
)
IS_BINARY_EXT = f"coalesce(lower({ext_of()}) IN ({BINARY_EXT}), false)"
LOC = f"CASE WHEN NOT {IS_BINARY_EXT} THEN CAST(len({lines_of('content')}) AS BIGINT) END"

TYPE = f"""CASE
  WHEN lower({NAME}) = 'dockerfile' OR starts_with(lower({NAME}), 'dockerfile.') THEN 'Dockerfile'
  WHEN lower({NAME}) IN ('makefile', 'gnumakefile') THEN 'Makefile'
  WHEN lower({NAME}) IN ('license', 'licence') OR starts_with(lower({NAME}), 'license.') THEN 'License'
  WHEN ends_with(lower({NAME}), 'ignore') THEN 'Ignore'
  WHEN ends_with(lower({NAME}), '.lock') OR lower({NAME}) = 'package-lock.json' THEN 'Lock'
  WHEN contains(lower({NAME}), 'test') OR contains(lower({NAME}), 'spec') THEN 'Test'
  ELSE coalesce(map {{'rs':'Rust','py':'Python','pyw':'Python','go':'Go','js':'JavaScript',
    'ts':'TypeScript','tsx':'TypeScript','java':'Java','sh':'Shell','md':'Markdown','txt':'Text',
    'json':'Json','yaml':'Yaml','yml':'Yaml','toml':'Toml','xml':'Xml','ini':'Ini','cfg':'Ini',
    'conf':'Ini'}}[lower({ext_of()})], 'Unknown')
END"""
TYPE_NAME = (
    "CASE file_type WHEN 'Dockerfile' THEN 'Docker' WHEN 'Makefile' THEN 'Make' WHEN 'Json' THEN 'JSON'"
    " WHEN 'Yaml' THEN 'YAML' WHEN 'Toml' THEN 'TOML' WHEN 'Xml' THEN 'XML' WHEN 'Ini' THEN 'INI'"
    " ELSE file_type END"
)
EMOJI = (
    "CASE file_type WHEN 'Directory' THEN '📁' WHEN 'Rust' THEN '🦀' WHEN 'Python' THEN '🐍' WHEN 'TypeScript' THEN '✨'"
    " WHEN 'Markdown' THEN '📘' WHEN 'Text' THEN '📄' WHEN 'Json' THEN '⚙️' WHEN 'Yaml' THEN '⚙️'"
    " WHEN 'Toml' THEN '⚙️' WHEN 'License' THEN '📜' WHEN 'Lock' THEN '📦' WHEN 'Dockerfile' THEN '🐳'"
    " WHEN 'Test' THEN '🧪' ELSE '📄' END"
)

# -- selection ---------------------------------------------------------------

HEAVY = (
    r"\.ssh|target|node_modules|vendor|dist|build|\.build|out|\.npm|\.yarn|\.pnpm-store|\.idea|\.vscode"
    r"|\.cache|__pycache__|\.git|logs|tmp|temp"
)


def unsafe(p: str) -> str:
    return (
        f"(regexp_matches({p}, '^\\.env(\\..*)?$') OR regexp_matches({p}, '(^|/)({HEAVY})/')"
        f" OR regexp_matches({p}, '\\.(pem|key|p12|pfx|crt|cer|der|keystore|jks|swp|swo|pyc|log)$')"
        f" OR regexp_matches({p}, '(_rsa|_dsa|_ecdsa|_ed25519|~)$') OR starts_with({p}, 'id_')"
        f" OR regexp_matches({p}, '(^|/)(credentials|secrets)(\\..*)?$')"
        f" OR {p} IN ('.DS_Store', 'Thumbs.db', 'desktop.ini'))"
    )


def unsafe_dir(d: str) -> str:
    return f"({unsafe(d)} OR {unsafe(f'({d} || chr(47))')})"


DECISION = """CASE WHEN reason IN ('path_include','included','default') THEN 'include'
  WHEN is_dir AND reason IN ('repository_data','ignored','unsafe','excluded','nested_repository') THEN 'prune'
  ELSE 'exclude' END"""


def decide(file_reason: str, dir_reason: str, prunes: str, extra: str = "") -> str:
    """Reasons of all entries: ``prunes`` is a test on an ancestor ``a``."""
    return f"""dead AS (SELECT DISTINCT corpus_id, path FROM anc2 WHERE {prunes}),
  r AS (SELECT e.corpus_id, e.path, is_dir,
    CASE WHEN dead.path IS NOT NULL THEN 'under_pruned_dir' {extra}
      WHEN is_dir THEN {dir_reason} ELSE {file_reason} END AS reason
    FROM e LEFT JOIN dead ON e.corpus_id = dead.corpus_id AND e.path = dead.path)"""


ANC2 = (
    "anc2 AS (SELECT corpus_id, path, array_to_string(string_split(path, '/')[1:i], '/') AS a"
    " FROM e, UNNEST(range(1, len(string_split(path, '/')))) u(i))"
)
SELECT_R = f"SELECT corpus_id, path, is_dir, {DECISION} AS decision, reason FROM r"

# include *.rs, *.md, src3/**/*.py; exclude docs, src3/vendor/**, test_*.rs
MIX_IN = "(e.path LIKE '%.rs' OR e.path LIKE '%.md' OR e.path LIKE 'src3/%.py')"
MIX_EX = (
    "(e.path LIKE 'docs/%' OR e.path LIKE '%/docs/%' OR e.path LIKE 'src3/vendor/%'"
    " OR regexp_matches(e.path, '(^|/)test_.*\\.rs$'))"
)
MIX_FILE = (
    f"CASE WHEN NOT {MIX_IN} THEN 'not_included' WHEN e.path LIKE 'src3/%.py' THEN 'path_include'"
    f" WHEN {MIX_EX} THEN 'excluded' ELSE 'included' END"
)
MIX_PRUNE = f"(a <> 'src3' AND a NOT LIKE 'src3/%' AND {unsafe_dir('a')})"
MIX_DIR = (
    f"CASE WHEN e.path = 'src3' OR e.path LIKE 'src3/%' THEN 'path_include'"
    f" WHEN {unsafe_dir('e.path')} THEN 'unsafe' ELSE 'included' END"
)
SAFE_FILE = f"CASE WHEN {unsafe('e.path')} THEN 'unsafe' ELSE 'default' END"
SAFE_DIR = f"CASE WHEN {unsafe_dir('e.path')} THEN 'unsafe' ELSE 'default' END"
# exclude docs, core/, src1*/config/**, *.sql


def prune_ex(p: str) -> str:
    return (
        f"({p} LIKE 'docs/%' OR {p} LIKE '%/docs/%' OR {p} LIKE 'core/%' OR {p} LIKE '%/core/%'"
        f" OR regexp_matches({p}, '^src1.*/config/.*$') OR {p} LIKE '%.sql')"
    )


def prune_ex_dir(d: str) -> str:
    return f"({prune_ex(d)} OR {prune_ex(f'({d} || chr(47))')})"


PRUNE_FILE = f"CASE WHEN {prune_ex('e.path')} THEN 'excluded' WHEN {unsafe('e.path')} THEN 'unsafe' ELSE 'default' END"
PRUNE_DIR = (
    f"CASE WHEN {unsafe_dir('e.path')} THEN 'unsafe' WHEN {prune_ex_dir('e.path')} THEN 'excluded' ELSE 'default' END"
)
PRUNE_TEST = f"({unsafe_dir('a')} OR {prune_ex_dir('a')})"


def file_only(file_reason: str, prunes: str) -> str:
    """Row-local decisions on the files."""
    return (
        f"WITH {docs()}, {entries()}, {ANC2}, {decide(file_reason, 'NULL', prunes)}"
        f" SELECT corpus_id, path, reason, {DECISION} AS decision FROM r WHERE NOT is_dir"
    )


def whole_tree(file_reason: str, dir_reason: str, prunes: str) -> str:
    return (
        f"WITH {docs()}, {entries()}, {ANC2}, {decide(file_reason, dir_reason, prunes)} {SELECT_R}"
    )


def drop_empty(condition: str) -> str:
    """Kept directories without a kept file below, where ``condition`` holds."""
    return f"""alive AS (SELECT DISTINCT anc2.corpus_id, a AS path FROM anc2 JOIN r
      ON anc2.corpus_id = r.corpus_id AND anc2.path = r.path
      WHERE NOT r.is_dir AND r.reason IN ('path_include','included','default')),
    r2 AS (SELECT r.corpus_id, r.path, r.is_dir,
      CASE WHEN r.is_dir AND alive.path IS NULL AND {condition}
        AND r.reason IN ('path_include','included','default') THEN 'empty' ELSE r.reason END AS reason
      FROM r LEFT JOIN alive ON r.corpus_id = alive.corpus_id AND r.path = alive.path)
    """


SELECT_R2 = f"SELECT corpus_id, path, is_dir, {DECISION} AS decision, reason FROM r2"


def ignoring(test: str, tree: str | None = None) -> str:
    """Tree under ignore rules alone; ``test(p, dir)`` with {p} and {d}."""
    on_a = test.format(c="corpus_id", p="a", d="true")
    on_self = test.format(c="e.corpus_id", p="e.path", d="is_dir")
    reason = f"CASE WHEN {on_self} THEN 'ignored' ELSE 'default' END"
    return (
        f"WITH {tree or docs()}, {entries()}, {ANC2}, {decide(reason, reason, on_a)} {SELECT_R}"
    )


# en: *.log, !f21.log, build/ ; de: /src1
IGN_ROOT = (
    "(({c} = 'en' AND (({p} LIKE '%.log' AND NOT regexp_matches({p}, '(^|/)f21\\.log$'))"
    " OR ({d} AND regexp_matches({p}, '(^|/)build$')))) OR ({c} = 'de' AND {p} = 'src1'))"
)
# fr in src4: docs/ ; es in src0/src: *.py
IGN_NESTED = (
    "(({c} = 'fr' AND {d} AND {p} LIKE 'src4/%' AND regexp_matches({p}, '/docs$'))"
    " OR ({c} = 'es' AND {p} LIKE 'src0/src/%' AND {p} LIKE '%.py'))"
)
IGN_AUTO = (
    f"(({{c}} IN ('en', 'fr') AND ({IGN_ROOT} OR {IGN_NESTED})))"
)
AUTO_TREE = (
    docs().replace("f AS (", "f0 AS (", 1)
    + ", f AS (SELECT corpus_id, path FROM f0 UNION ALL SELECT DISTINCT corpus_id, '.git/HEAD' FROM f0"
    " WHERE corpus_id IN ('en', 'fr'))"
)
FILES_TREE = (
    docs().replace("f AS (", "f0 AS (", 1)
    + ", f AS (SELECT corpus_id, path FROM f0 UNION ALL SELECT DISTINCT corpus_id, '.gitignore' FROM f0"
    " UNION ALL SELECT DISTINCT corpus_id, regexp_extract(path, '^(src\\d+/docs/)', 1) || '.gitignore'"
    " FROM f0 WHERE regexp_matches(path, '^src\\d+/docs/'))"
)
# root: *.yml, !f1*.yml, /src2/, target/ ; srcN/docs: *.md, /d*, !f1*.yml
IGN_FILES = (
    "(({p} LIKE '%.yml' AND NOT regexp_matches({p}, '(^|/)f1[^/]*\\.yml$')) OR ({d} AND {p} = 'src2')"
    " OR ({d} AND regexp_matches({p}, '(^|/)target$'))"
    " OR (regexp_matches({p}, '^src\\d+/docs/') AND ({p} LIKE '%.md'"
    " OR regexp_matches({p}, '^src\\d+/docs/d[^/]*$'))))"
)
# en: *.log, !f1*.md ; en/sub: *.md ; es: info/exclude *.sql ; everywhere in a repository: *.toml ; fr is in none.
# de lies in en/sub: the nearer *.md comes first, the outer !f1*.md overrules it.
IGN_ABOVE = (
    "(({c} = 'en' AND ({p} LIKE '%.log' OR {p} LIKE '%.toml'))"
    " OR ({c} = 'es' AND ({p} LIKE '%.sql' OR {p} LIKE '%.toml'))"
    " OR ({c} = 'de' AND ({p} LIKE '%.log' OR {p} LIKE '%.toml'"
    " OR ({p} LIKE '%.md' AND NOT regexp_matches({p}, '(^|/)f1[^/]*\\.md$')))))"
)
ABOVE_TREE = (
    docs().replace("f AS (", "f0 AS (", 1)
    + ", f AS (SELECT corpus_id, path FROM f0 UNION ALL SELECT DISTINCT corpus_id, m FROM f0 JOIN (VALUES ('en', '.git/HEAD'),"
    " ('en', '.gitignore'), ('en', 'sub/.gitignore'), ('fr', '.gitignore'), ('es', '.git/info/exclude')) t(c, m) ON c = corpus_id)"
)
REPO = "a IN ('src3/third_party/dep', 'src7/third_party/dep')"
REPO_TREE = (
    docs().replace("f AS (", "f0 AS (", 1)
    + ", f AS (SELECT corpus_id, path, content, size_bytes FROM f0 UNION ALL"
    " SELECT corpus_id, m || '/third_party/dep/.git', '', 0"
    " FROM (SELECT DISTINCT corpus_id FROM f0), (VALUES ('src3'), ('src7')) t(m))"
)
REPO_SELF = "WHEN is_dir AND e.path IN ('src3/third_party/dep', 'src7/third_party/dep') THEN 'nested_repository'"
REPO_SELECTION = (
    f"{entries()}, {ANC2},"
    f" {decide(SAFE_FILE, SAFE_DIR, f'({REPO} OR {unsafe_dir(chr(97))})', REPO_SELF)}, {drop_empty('true')}"
)

# -- listing -----------------------------------------------------------------

HEX_KEY = """(SELECT coalesce(string_agg(hex(encode((CASE WHEN i < len(string_split(path, '/')) OR is_dir THEN '0' ELSE '1' END)
    || string_split(path, '/')[i])), '00' ORDER BY i), '')
    FROM UNNEST(range(1, len(string_split(path, '/')) + 1)) u(i))"""


def tree(branch: str, last: str, on: str, off: str, src: str = "e") -> str:
    """Layout of a table of entries: flags by sibling window, prefix by chain."""
    return f"""flag AS (SELECT *, {PARENT} AS parent,
      lead(path) OVER (PARTITION BY corpus_id, {PARENT} ORDER BY NOT is_dir DESC, {NAME} DESC) AS unused,
      row_number() OVER (PARTITION BY corpus_id, {PARENT} ORDER BY (NOT is_dir) DESC, {NAME} DESC) = 1 AS is_last
      FROM {src}),
    chain AS (SELECT c.corpus_id, c.path, string_agg(CASE WHEN p.is_last THEN '{off}' ELSE '{on}' END, '' ORDER BY c.i) AS prefix
      FROM (SELECT DISTINCT corpus_id, path, i, array_to_string(string_split(path, '/')[1:i], '/') AS a
            FROM {src}, UNNEST(range(1, len(string_split(path, '/')))) u(i)) c
      JOIN flag p ON p.corpus_id = c.corpus_id AND p.path = c.a AND p.is_dir
      GROUP BY 1, 2),
    laid AS (SELECT flag.*, coalesce(prefix, '') AS prefix,
      CASE WHEN is_last THEN '{last}' ELSE '{branch}' END AS branch, {NAME.replace('path', 'flag.path')} AS name
      FROM flag LEFT JOIN chain ON chain.corpus_id = flag.corpus_id AND chain.path = flag.path)"""


def hex_key(table: str) -> str:
    return f"keyed AS (SELECT t.*, {HEX_KEY.replace('path', 't.path').replace('is_dir', 't.is_dir')} AS sort_hex FROM {table} t)"


PLAIN = ("├── ", "└── ", "│   ", "    ")
UNICODE = ("├─ ", "└─ ", "│  ", "   ")
ASCII = ("|-- ", "`-- ", "|   ", "    ")

OUTLIERS = """ocnt AS (SELECT corpus_id, count(*) AS n FROM l WHERE loc IS NOT NULL GROUP BY 1),
  ranked AS (SELECT corpus_id, loc, row_number() OVER (PARTITION BY corpus_id ORDER BY loc DESC) AS rn
    FROM l WHERE loc IS NOT NULL),
  thr AS (SELECT ranked.corpus_id, loc AS threshold FROM ranked JOIN ocnt USING (corpus_id)
    WHERE rn = least(CAST(ceil(n * 0.05) AS BIGINT), least(10, n)))"""

BAR = """CASE WHEN loc IS NULL THEN NULL WHEN loc < 10 THEN '[' || repeat('·', 10) || ']' ELSE
  '[' || repeat('█', CAST(filled AS INT)) || repeat('·', 10 - CAST(filled AS INT)) || ']' END"""
FILLED = (
    "least(greatest(ceil(CAST(least(loc, 1000) AS DOUBLE) / CAST(least(greatest(max_loc, 1), 1000) AS DOUBLE)"
    " * CAST(10 AS DOUBLE)), 1), 10)"
)
LOC_CLASS = (
    "CASE WHEN loc IS NULL THEN NULL WHEN loc <= 10 THEN 'XS' WHEN loc <= 120 THEN 'S' WHEN loc <= 300 THEN 'M'"
    " WHEN loc <= 600 THEN 'L' WHEN loc <= 1000 THEN 'XL' ELSE 'XXL' END"
)
LOC_LABEL = "CASE WHEN loc >= 1000 THEN '1k+' ELSE CAST(loc AS VARCHAR) END"


def count_label(c: str) -> str:
    return (
        f"CASE WHEN {c} >= 1000000 THEN printf('%.1fM', CAST({c} AS DOUBLE) / CAST(1000000 AS DOUBLE))"
        f" WHEN {c} >= 1000 THEN printf('%.1fK', CAST({c} AS DOUBLE) / CAST(1000 AS DOUBLE))"
        f" ELSE CAST({c} AS VARCHAR) END"
    )


def human(b: str) -> str:
    d = f"CAST({b} AS DOUBLE)"
    return (
        f"CASE WHEN {b} < 1024 THEN {b} || ' B' WHEN {b} < 1048576 THEN printf('%.1f KB', {d} / CAST(1024 AS DOUBLE))"
        f" WHEN {b} < 1073741824 THEN printf('%.1f MB', {d} / CAST(1048576 AS DOUBLE))"
        f" ELSE printf('%.1f GB', {d} / CAST(1073741824 AS DOUBLE)) END"
    )


F32 = "CAST(CAST(n_files AS FLOAT) / CAST(total AS FLOAT) AS FLOAT) * CAST(100 AS FLOAT)"
BREAKDOWN = f"""cnt AS (SELECT corpus_id, file_type, count(*) AS n_files FROM t GROUP BY 1, 2),
  br AS (SELECT *, sum(n_files) OVER (PARTITION BY corpus_id) AS total,
    row_number() OVER (PARTITION BY corpus_id ORDER BY n_files DESC, file_type) AS rank FROM cnt),
  br8 AS (SELECT *, {F32} AS pct, {TYPE_NAME} AS type_name FROM br WHERE rank <= 8)"""
SHARE = "CAST(round_even(CAST(pct AS DOUBLE), 0) AS INTEGER)"
TOTALS = """tot AS (SELECT corpus_id, CAST(count(*) FILTER (NOT is_dir) AS BIGINT) AS n_files,
  CAST(count(*) FILTER (is_dir) + 1 AS BIGINT) AS n_dirs, CAST(sum(loc) AS BIGINT) AS loc FROM el GROUP BY 1)"""


def totals_text(head: str) -> str:
    return (
        f"'**{head}**: 📂 ' || n_dirs || ' dirs • 📄 ' || n_files || ' files' ||"
        f" coalesce(' • 🧾 ~' || ({count_label('loc')}) || ' LOC', '')"
    )


DOC_LOC = f"el AS (SELECT corpus_id, path, false AS is_dir, {LOC} AS loc FROM f UNION ALL SELECT DISTINCT corpus_id, a, true, NULL FROM anc)"


def share_bar(full: str, empty: str) -> str:
    cells = "least(CAST(round(CAST(pct * CAST(15 AS FLOAT) / CAST(100 AS FLOAT) AS FLOAT)) AS INT), 15)"
    return f"repeat('{full}', {cells}) || repeat('{empty}', 15 - {cells})"


def full_rows(label: str, full: str, empty: str) -> str:
    return f"""SELECT corpus_id, 0 AS seq, {totals_text('Totals')} AS line FROM tot
      UNION ALL SELECT corpus_id, 1, '' FROM tot WHERE n_files > 0
      UNION ALL SELECT corpus_id, 2, '**By type**:' FROM tot WHERE n_files > 0
      UNION ALL SELECT corpus_id, rank + 2, '- ' || {label} || type_name || ': ' || n_files || ' (' || {SHARE} || '%) '
        || {share_bar(full, empty)} FROM br8"""


# -- packing -----------------------------------------------------------------

READY = f"rd AS (SELECT *, octet_length(encode(content)) AS bytes, {lines_of('content')} AS ls FROM f WHERE NOT {IS_BINARY_EXT})"
HINT = f"""coalesce(map {{'go':'go','py':'python','rs':'rust','js':'javascript','ts':'typescript','tsx':'tsx',
  'sh':'shell','html':'html','css':'css','scss':'scss','sass':'sass','json':'json','toml':'toml','yaml':'yaml',
  'yml':'yaml','sql':'sql','md':'markdown'}}[lower({ext_of()})], '')"""


def section(kept: str, omitted: str) -> str:
    return (
        f"{NL} || '## ' || path || {NL} || {NL} || '```' || {HINT} || {NL} || {kept}"
        f" || CASE WHEN ends_with({kept}, {NL}) THEN '' ELSE {NL} END"
        f" || CASE WHEN {omitted} > 0 THEN '... (' || {omitted} || ' lines omitted)' || {NL} ELSE '' END"
        f" || '```' || {NL}"
    )


def head_n(budget: int) -> str:
    """Largest head length that fits, every length tried against every file."""
    return f"""lens AS (SELECT corpus_id, path, bytes, len(ls) AS nl,
      list_transform(ls, lambda x: octet_length(encode(x))) AS lb FROM rd),
    size AS (SELECT corpus_id, sum(bytes) AS total, max(nl) AS max_nl FROM lens GROUP BY 1),
    cand AS (SELECT corpus_id, n FROM size, UNNEST(range(0, max_nl + 1)) u(n)),
    tried AS (SELECT cand.corpus_id, n,
      sum(CASE WHEN n >= nl THEN bytes WHEN n = 0 THEN 0 ELSE list_sum(lb[1:n]) + n - 1 END) AS s
      FROM cand JOIN lens ON lens.corpus_id = cand.corpus_id GROUP BY 1, 2),
    hn AS (SELECT size.corpus_id, total <= {budget} AS whole, max(n) FILTER (s <= {budget}) AS n
      FROM size LEFT JOIN tried ON tried.corpus_id = size.corpus_id GROUP BY 1, 2)"""


HEAD_TEXT = f"CASE WHEN n >= len(ls) THEN content ELSE coalesce(array_to_string(ls[1:n], {NL}), '') END"


def packed_head(budget: int) -> str:
    return f"""{READY}, {head_n(budget)},
    cut AS (SELECT rd.corpus_id, path, CASE WHEN whole THEN 'full' ELSE 'head' END AS method,
      CAST(CASE WHEN NOT whole THEN n END AS INTEGER) AS n,
      CASE WHEN whole THEN content ELSE {HEAD_TEXT} END AS kept,
      CAST(CASE WHEN whole THEN 0 ELSE greatest(len(ls) - n, 0) END AS INTEGER) AS omitted
      FROM rd JOIN hn ON hn.corpus_id = rd.corpus_id)"""


INDENT = f"CASE WHEN ltrim(x, {WS}) = '' THEN 0 ELSE octet_length(encode(x)) - octet_length(encode(ltrim(x, {WS}))) END"


def fold(cands: str) -> str:
    """Folded text of files at depths; ``cands`` gives (corpus_id, path, t)."""
    return f"""ln AS (SELECT corpus_id, path, i, ls[i] AS x FROM rd, UNNEST(range(1, len(ls) + 1)) u(i)),
    ind AS (SELECT *, {INDENT} AS d FROM ln),
    cands AS ({cands}),
    marked AS (SELECT ind.corpus_id, ind.path, t, i, x, d > t AS hid,
      sum(CASE WHEN d > t THEN 0 ELSE 1 END) OVER (PARTITION BY ind.corpus_id, ind.path, t ORDER BY i) AS g
      FROM ind JOIN cands ON cands.corpus_id = ind.corpus_id AND (cands.path IS NULL OR cands.path = ind.path)),
    pieces AS (SELECT corpus_id, path, t, min(i) AS i, any_value(x) AS txt, 0 AS k FROM marked WHERE NOT hid
        GROUP BY corpus_id, path, t, g
      UNION ALL SELECT corpus_id, path, t, min(i), '... (' || count(*) || ' lines)', count(*) FROM marked WHERE hid
        GROUP BY corpus_id, path, t, g),
    folded AS (SELECT corpus_id, path, t, ltrim(string_agg(txt, {NL} ORDER BY i), {NL}) AS txt, sum(k) AS k
      FROM pieces GROUP BY 1, 2, 3)"""


def packed_nest(budget: int) -> str:
    return f"""{READY}, {head_n(budget)},
    top AS (SELECT corpus_id, coalesce(max({INDENT.replace('x,', 'x,')}), 0) AS m
      FROM (SELECT corpus_id, UNNEST(ls) AS x FROM rd) GROUP BY 1),
    {fold("SELECT corpus_id, NULL AS path, t FROM top, UNNEST(range(0, m + 1)) u(t)")},
    nt AS (SELECT corpus_id, max(t) AS t FROM (SELECT corpus_id, t, sum(octet_length(encode(txt))) AS s FROM folded GROUP BY 1, 2)
      WHERE s <= {budget} GROUP BY 1),
    cut AS (SELECT rd.corpus_id, rd.path,
      CASE WHEN whole THEN 'full' WHEN nt.t IS NOT NULL THEN 'nest' ELSE 'head' END AS method,
      CAST(CASE WHEN whole THEN NULL ELSE coalesce(nt.t, hn.n) END AS INTEGER) AS n,
      CASE WHEN whole THEN content WHEN nt.t IS NOT NULL THEN coalesce(folded.txt, '')
        ELSE {HEAD_TEXT.replace('n >=', 'hn.n >=').replace('1:n', '1:hn.n')} END AS kept,
      CAST(CASE WHEN whole THEN 0 WHEN nt.t IS NOT NULL THEN coalesce(folded.k, 0)
        ELSE greatest(len(ls) - hn.n, 0) END AS INTEGER) AS omitted
      FROM rd JOIN hn ON hn.corpus_id = rd.corpus_id LEFT JOIN nt ON nt.corpus_id = rd.corpus_id
      LEFT JOIN folded ON folded.corpus_id = rd.corpus_id AND folded.path = rd.path AND folded.t = nt.t)"""


PACKED = f"SELECT corpus_id, path, method, n, omitted, {section('kept', 'omitted')} AS section FROM cut"


# -- statements --------------------------------------------------------------


def _statements() -> dict[str, str]:
    q: dict[str, str] = {}
    d = docs()

    q["path_columns"] = (
        f"WITH {d} SELECT corpus_id, path, {NAME} AS name, {ext_of()} AS ext, {PARENT} AS parent,"
        " CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM f"
    )
    q["entry_listing"] = f"WITH {d}, {entries()} SELECT corpus_id, path, is_dir FROM e"
    q["rejected_entries"] = (
        f"WITH {d}, x AS (SELECT corpus_id, CASE WHEN octet_length(encode(path)) % 7 = 0 THEN 'path_not_utf8'"
        " WHEN octet_length(encode(path)) % 5 = 0 THEN 'symlink' END AS reject_reason FROM f)"
        " SELECT corpus_id, reject_reason, count(*) AS n FROM x WHERE reject_reason IS NOT NULL GROUP BY 1, 2"
    )
    q["walkable_entries"] = (
        f"WITH {d} SELECT corpus_id, path FROM f WHERE octet_length(encode(path)) % 5 <> 0"
    )
    q["manifest_hints"] = (
        f"WITH {d} SELECT corpus_id, path, octet_length(encode(path)) % 3 = 0 AS is_dir, false AS is_symlink FROM f"
    )
    kids = "count(*) FILTER (NOT is_dir) AS n_files, count(*) FILTER (is_dir) AS n_dirs"
    q["dir_children"] = (
        f"WITH {d}, {entries()} SELECT corpus_id, {PARENT} AS parent, {kids} FROM e GROUP BY 1, 2"
    )
    extra = (
        f"{d}, g AS (SELECT corpus_id, path FROM f UNION ALL"
        f" SELECT corpus_id, {PARENT} || '/empty/x' FROM f WHERE ends_with(path, '/Dockerfile')),"
        f" {ANCESTORS.format(src='g')}, e AS (SELECT corpus_id, path, false AS is_dir FROM f UNION ALL"
        " SELECT DISTINCT corpus_id, a, true FROM anc)"
    )
    q["dir_parent_join"] = (
        f"WITH {extra}, k AS (SELECT corpus_id, {PARENT} AS parent, {kids} FROM e GROUP BY 1, 2)"
        " SELECT e.corpus_id, e.path, coalesce(n_files, 0) AS n_files, coalesce(n_dirs, 0) AS n_dirs FROM e"
        " LEFT JOIN k ON k.corpus_id = e.corpus_id AND k.parent = e.path WHERE is_dir"
    )
    q["empty_dirs"] = (
        f"WITH {extra} SELECT corpus_id, path FROM e WHERE is_dir AND NOT EXISTS"
        " (SELECT 1 FROM e c WHERE c.corpus_id = e.corpus_id AND starts_with(c.path, e.path || '/'))"
    )
    size = "octet_length(encode(path))"
    q["path_clean"] = f"""WITH {d}, x AS (SELECT corpus_id, path, CASE WHEN {size} % 4 = 0 THEN './' || replace(path, '/', '//')
      WHEN {size} % 4 = 1 THEN '//' || path || '///' WHEN {size} % 4 = 2 THEN replace(path, '/', chr(92))
      ELSE replace(path, '/', '/./') END AS written FROM f)
      SELECT corpus_id, written, CASE WHEN {size} % 4 IN (0, 2) THEN path WHEN {size} % 4 = 1 THEN '/' || path
      ELSE written END AS cleaned, replace(written, chr(92), '/') AS match_form, {size} % 4 = 1 AS dir_hint FROM x"""
    q["path_relative"] = f"WITH {d} SELECT corpus_id, path[6:] AS path FROM f WHERE starts_with(path, 'src1/')"
    q["path_display"] = f"""WITH {d} SELECT corpus_id, path, CASE WHEN starts_with(path, 'src1/docs/') THEN path[11:]
      WHEN starts_with(path, 'src1/') THEN '../' || path[6:] ELSE '../../' || path END AS shown,
      starts_with(path, 'src1/') AS inside FROM f"""

    q["file_types"] = (
        f"WITH {d}, t AS (SELECT corpus_id, path, {TYPE} AS file_type FROM f)"
        f" SELECT corpus_id, path, file_type, {TYPE_NAME} AS type_name FROM t"
    )
    t = f"t AS (SELECT corpus_id, path, {TYPE} AS file_type FROM f)"
    q["type_breakdown"] = (
        f"WITH {d}, {t}, {BREAKDOWN} SELECT corpus_id, CAST(rank AS INTEGER) AS rank, file_type, type_name, n_files,"
        f" {SHARE} AS share FROM br8"
    )
    q["url_type_breakdown"] = (
        f"WITH {PAGES}, {t}, {BREAKDOWN} SELECT corpus_id, CAST(rank AS INTEGER) AS rank, file_type, n_files,"
        f" {SHARE} AS share FROM br8"
    )
    q["lang_hint"] = (
        f"WITH {d} SELECT corpus_id, path, CASE lower({ext_of()}) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python'"
        " WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'toml' THEN 'toml' WHEN 'tsx' THEN 'tsx'"
        " WHEN 'yml' THEN 'yaml' WHEN 'sql' THEN 'sql' END AS language FROM f"
    )
    q["profile_registry"] = (
        f"WITH {d} SELECT corpus_id, path, CASE WHEN {ext_of()} = 'rs' THEN 'Rust' WHEN {ext_of()} = 'py' THEN 'Python'"
        f" WHEN {ext_of()} = 'tsx' THEN 'TypeScript' ELSE {TYPE} END AS profile_type FROM f"
    )
    q["labels_join"] = (
        f"WITH {d}, {t} SELECT corpus_id, path, file_type, CASE WHEN {ext_of()} = 'rs' THEN 'R'"
        f" WHEN file_type = 'Python' THEN 'P' WHEN file_type = 'Markdown' THEN 'M' ELSE {EMOJI} END AS label FROM t"
    )
    q["label_arguments"] = (
        f"WITH {d}, {t} SELECT corpus_id, path, file_type, CASE WHEN {ext_of()} = 'rs' THEN 'R'"
        f" WHEN {ext_of()} = 'tsx' THEN 'T' WHEN file_type = 'Python' THEN 'P' WHEN file_type = 'Markdown' THEN 'M'"
        f" ELSE {EMOJI} END AS label FROM t"
    )
    short = " ".join(f"WHEN {ext_of()} = '{e}' THEN '{k}'" for e, k in (("log", "L"), ("png", "I"), ("lock", "K"), ("pem", "E")))
    q["type_labels"] = f"""WITH {d}, t AS (SELECT corpus_id, path, false AS is_dir, {TYPE} AS file_type, {LOC} AS loc FROM f),
      l AS (SELECT *, CASE {short} ELSE {EMOJI} END AS label FROM t), {hex_key('l')}
      SELECT corpus_id, file_type, count(*) AS n_files, CAST(sum(loc) AS BIGINT) AS loc, arg_min(label, sort_hex) AS label FROM keyed GROUP BY 1, 2"""
    hexed = "regexp_extract_all(hex(encode(content)[1:8192]), '..')"
    control = f"len(list_filter({hexed}, lambda h: h < '20' AND h NOT IN ('09', '0A', '0D')))"
    q["binary_gate"] = f"""WITH {d}, x AS (SELECT corpus_id, path, CASE WHEN {size} % 7 = 0 THEN content || chr(0)
      WHEN {size} % 5 = 0 THEN replace(content, 'e', chr(1)) ELSE content END AS content FROM f),
      y AS (SELECT *, CAST(least(octet_length(encode(content)), 8192) AS INTEGER) AS sample_bytes FROM x)
      SELECT corpus_id, path, {IS_BINARY_EXT} AS binary_ext,
      list_contains({hexed}, '00') OR {control} > sample_bytes // 10 AS looks_binary, sample_bytes,
      octet_length(encode(content)) * 1000 > 10485760 AS too_large FROM y"""
    q["readable_text"] = (
        f"WITH {d} SELECT corpus_id, path, CAST(size_bytes AS INTEGER) AS n_bytes FROM f"
        f" WHERE NOT {IS_BINARY_EXT} AND {size} % 3 <> 0"
    )

    q["loc_fast"] = f"WITH {d} SELECT corpus_id, path, {LOC} AS loc FROM f"
    code = "NOT regexp_matches(trim(x, {ws}), '^(//|#|/\\*|\\*)') AND trim(x, {ws}) <> '' AND NOT regexp_matches(x, '^[A-M]')"
    q["loc_accurate"] = (
        f"WITH {d} SELECT corpus_id, path, CASE WHEN NOT {IS_BINARY_EXT} THEN CAST(len(list_filter("
        f"string_split(content, {NL}), lambda x: {code.format(ws=WS)})) AS BIGINT) END AS loc FROM f"
    )
    l = f"l AS (SELECT corpus_id, path, {PARENT} AS parent, {LOC} AS loc FROM f)"
    scaled = (
        "s AS (SELECT *, coalesce(max(loc) OVER (PARTITION BY corpus_id, parent), 0) AS max_loc FROM l),"
        f" b AS (SELECT *, {FILLED} AS filled FROM s)"
    )
    q["loc_class_bar"] = (
        f"WITH {d}, {l}, {scaled} SELECT corpus_id, path, loc, {LOC_CLASS} AS loc_class, {LOC_LABEL} AS loc_label,"
        f" {BAR} AS bar FROM b"
    )
    q["loc_outliers"] = (
        f"WITH {d}, {l}, {OUTLIERS} SELECT l.corpus_id, path, loc, threshold,"
        " coalesce(loc >= threshold, false) AS outlier FROM l LEFT JOIN thr ON thr.corpus_id = l.corpus_id"
    )
    wide = "(size_bytes * size_bytes)"
    place = (
        f"least(greatest((ln(CAST({wide} AS DOUBLE)) - ln(CAST(1024 AS DOUBLE)))"
        " / (ln(CAST(100000000 AS DOUBLE)) - ln(CAST(1024 AS DOUBLE))), 0), 1)"
    )
    q["size_class"] = f"""WITH {d} SELECT corpus_id, path, CAST(size_bytes AS BIGINT) AS size_bytes, {human('size_bytes')} AS human,
      {human(wide)} AS wide_human, CASE WHEN {wide} <= 1024 THEN 'XS' WHEN {wide} <= 8192 THEN 'S'
      WHEN {wide} <= 65536 THEN 'M' WHEN {wide} <= 524288 THEN 'L' WHEN {wide} <= 4194304 THEN 'XL' ELSE 'XXL' END AS badge,
      CASE WHEN {wide} > 1024 THEN (['▁','▂','▃','▄','▅','▆','▇'])[1 + CAST(round({place} * 6) AS INT)] END AS tick FROM f"""

    q["corpus_totals"] = f"WITH {d}, {entries()}, {DOC_LOC}, {TOTALS} SELECT * FROM tot"
    q["type_loc"] = (
        f"WITH {d}, t AS (SELECT corpus_id, {TYPE} AS file_type, {LOC} AS loc FROM f)"
        " SELECT corpus_id, file_type, count(*) AS n_files, CAST(sum(loc) AS BIGINT) AS loc FROM t GROUP BY 1, 2"
    )
    xc = f"xc AS (SELECT corpus_id, coalesce(lower({ext_of()}), '(no ext)') AS ext, count(*) AS n_files FROM f GROUP BY 1, 2)"
    q["ext_counts"] = f"WITH {d}, {xc} SELECT * FROM xc"
    top5 = (
        "x5 AS (SELECT corpus_id, ext, n_files, CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY n_files DESC, ext)"
        " AS INTEGER) AS rank, replace(replace(ext, '(no ext)', 'no-ext'), '', '') || '(' || n_files || ')' AS shown FROM xc"
        " QUALIFY rank <= 5)"
    )
    q["ext_top5"] = f"WITH {d}, {xc}, {top5} SELECT corpus_id, ext, n_files, rank, shown FROM x5"
    q["name_width"] = (
        f"WITH {d} SELECT corpus_id, CAST(max(octet_length(encode({NAME}))) + 10 AS INTEGER) AS name_width FROM f GROUP BY 1"
    )
    q["stats_min"] = (
        f"WITH {d}, {entries()}, {DOC_LOC}, {TOTALS} SELECT corpus_id, 0 AS seq, {totals_text('Stats')} AS line FROM tot"
    )
    emoji = f"{EMOJI} || ' '"
    q["stats_full"] = (
        f"WITH {d}, {entries()}, {t}, {DOC_LOC}, {TOTALS}, {BREAKDOWN}, rows AS ({full_rows(emoji, '▰', '▱')})"
        " SELECT corpus_id, CAST(seq AS INTEGER) AS seq, line FROM rows"
    )
    q["stats_footer"] = f"""WITH {d}, {entries()}, {DOC_LOC}, {TOTALS}, {xc}, {top5}
      SELECT corpus_id, 0 AS seq, '**Stats**' AS line FROM tot
      UNION ALL SELECT corpus_id, 1, '- Dirs: ' || n_dirs FROM tot
      UNION ALL SELECT corpus_id, 2, '- Files: ' || n_files FROM tot
      UNION ALL SELECT corpus_id, 3, '- Top by ext: ' || string_agg(shown, ', ' ORDER BY rank) FROM x5 GROUP BY 1"""
    q["url_tree_totals"] = (
        f"WITH {PAGES}, {entries()} SELECT corpus_id, count(*) FILTER (NOT is_dir) AS n_files,"
        " count(*) FILTER (is_dir) + 1 AS n_dirs,"
        " (SELECT CAST(sum(size_bytes) AS BIGINT) FROM f WHERE f.corpus_id = e.corpus_id) AS total_bytes FROM e GROUP BY 1"
    )

    q["depth_limit"] = (
        f"WITH {d}, {entries()} SELECT corpus_id, path, is_dir FROM e WHERE len(string_split(path, '/')) <= 2"
    )
    q["include_exclude"] = file_only(MIX_FILE, MIX_PRUNE)
    ext_file = f"CASE WHEN coalesce(lower({ext_of('e.path')}) IN ('rs', 'py'), false) THEN 'included' ELSE 'not_included' END"
    ext_prune = unsafe_dir("a")
    q["include_ext"] = file_only(ext_file, ext_prune)
    q["safety_filter"] = file_only(SAFE_FILE, unsafe_dir("a"))
    q["safety_off"] = file_only("'default'", "false")
    q["dir_prune"] = whole_tree(PRUNE_FILE, PRUNE_DIR, PRUNE_TEST)
    q["include_tree"] = (
        f"WITH {d}, {entries()}, {ANC2}, {decide(MIX_FILE, MIX_DIR, MIX_PRUNE)}, {drop_empty('true')} {SELECT_R2}"
    )
    q["ignore_root"] = ignoring(IGN_ROOT)
    q["ignore_nested"] = ignoring(IGN_NESTED)
    git_self = "WHEN is_dir AND e.path = '.git' THEN 'repository_data'"
    auto_a = IGN_AUTO.format(c="corpus_id", p="a", d="true")
    auto_self = IGN_AUTO.format(c="e.corpus_id", p="e.path", d="is_dir")
    reason = f"CASE WHEN {auto_self} THEN 'ignored' ELSE 'default' END"
    dead_test = f"(a = '.git' OR {auto_a})"
    q["ignore_auto"] = (
        f"WITH {AUTO_TREE}, {entries()}, {ANC2}, {decide(reason, reason, dead_test, git_self)} {SELECT_R}"
    )
    q["ignore_files"] = ignoring(IGN_FILES, FILES_TREE)
    q["nested_repo_prune"] = f"WITH {REPO_TREE}, {REPO_SELECTION} {SELECT_R2}"

    doc_tree = (
        f"{d}, {ANCESTORS.format(src='f')}, {DOC_LOC}, {tree(*PLAIN, src='el')}, {hex_key('laid')}"
    )
    suffix = "CASE WHEN is_dir THEN '/' WHEN loc IS NOT NULL THEN '  (' || loc || ' lines)' ELSE '' END"
    q["tree_rows"] = (
        f"WITH {doc_tree} SELECT corpus_id, sort_hex, prefix || branch || name || {suffix} AS line FROM keyed"
        " UNION ALL SELECT DISTINCT corpus_id, '', '.' FROM f"
    )
    q["url_tree_rows"] = (
        f"WITH {PAGES}, {entries()}, {tree(*ASCII)}, {hex_key('laid')} SELECT corpus_id, sort_hex,"
        " prefix || branch || name || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM keyed"
        " UNION ALL SELECT DISTINCT corpus_id, '', '.' FROM f"
    )
    note = f"CASE WHEN is_dir THEN 'Directory' ELSE {TYPE} END"
    annotated = (
        f"{d}, {ANCESTORS.format(src='f')}, {DOC_LOC}, l AS (SELECT * FROM el), {OUTLIERS}, {tree(*UNICODE, src='el')},"
        f" {hex_key('laid')}, s AS (SELECT keyed.*, {note} AS file_type, threshold,"
        " coalesce(max(loc) OVER (PARTITION BY keyed.corpus_id, parent), 0) AS max_loc"
        " FROM keyed LEFT JOIN thr ON thr.corpus_id = keyed.corpus_id),"
        f" b AS (SELECT *, {FILLED} AS filled FROM s),"
        f" ann AS (SELECT corpus_id, path, sort_hex, prefix || branch || {EMOJI} || ' ' || name || CASE WHEN is_dir THEN '/' ELSE '' END AS line,"
        f" {BAR} AS bar, {LOC_LABEL} AS loc_label, {LOC_CLASS} AS loc_class,"
        " CASE WHEN coalesce(loc >= threshold, false) THEN ' ★' ELSE '' END AS star FROM b)"
    )
    q["tree_annotated"] = f"WITH {annotated} SELECT corpus_id, path, line, bar, loc_label, loc_class, star FROM ann"

    q["readable_bytes"] = (
        f"WITH {d} SELECT corpus_id, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM f WHERE NOT {IS_BINARY_EXT} GROUP BY 1"
    )
    q["pack_whole"] = f"WITH {d}, {READY} SELECT corpus_id, path, {section('content', '0')} AS section FROM rd"
    q["pack_fit"] = f"WITH {d}, {packed_head(WIDE_BUDGET)} {PACKED}"
    q["pack_head"] = f"WITH {d}, {packed_head(HEAD_BUDGET)} {PACKED}"
    q["pack_nest"] = f"WITH {docs(INDENTED)}, {packed_nest(NEST_BUDGET)} {PACKED}"
    q["pack_nest_tight"] = f"WITH {docs(INDENTED)}, {packed_nest(TIGHT_BUDGET)} {PACKED}"
    q["nest_parameters"] = (
        f"WITH {docs(BLOCKS)}, {packed_nest(NEST_BUDGET)}"
        " SELECT corpus_id, any_value(method) AS method, any_value(n) AS n FROM cut GROUP BY 1"
    )
    q["fold_lines"] = (
        f"WITH {docs(INDENTED)}, rd AS (SELECT *, {lines_of('content')} AS ls FROM f),"
        f" {fold('SELECT corpus_id, path, 4 AS t FROM rd')} SELECT rd.corpus_id, rd.path, coalesce(txt, '') AS text,"
        " CAST(coalesce(k, 0) AS INTEGER) AS omitted FROM rd LEFT JOIN folded"
        " ON folded.corpus_id = rd.corpus_id AND folded.path = rd.path"
    )

    # Whole jobs: selection, then listing, report and sections of what is kept.
    kept = (
        "kept AS (SELECT r2.corpus_id, r2.path, r2.is_dir, f.content, f.size_bytes FROM r2 LEFT JOIN f"
        " ON f.corpus_id = r2.corpus_id AND f.path = r2.path AND NOT r2.is_dir"
        " WHERE reason IN ('path_include','included','default'))"
    )
    el = f"el AS (SELECT corpus_id, path, is_dir, CASE WHEN NOT is_dir THEN {LOC} END AS loc FROM kept)"
    sections = packed_head(HEAD_BUDGET).replace("FROM f WHERE", "FROM (SELECT * FROM kept WHERE NOT is_dir) WHERE")
    q["plain_listing"] = f"""WITH {REPO_TREE}, {REPO_SELECTION}, {kept}, {el}, {TOTALS}, {tree(*PLAIN, src='el')}, {hex_key('laid')},
      {sections}, ck AS (SELECT cut.*, false AS is_dir FROM cut), sk AS (SELECT t.*, {HEX_KEY.replace('path', 't.path').replace('is_dir', 't.is_dir')} AS sort_hex FROM ck t)
      SELECT corpus_id, 0 AS block, sort_hex, prefix || branch || name || {suffix} AS line FROM keyed
      UNION ALL SELECT DISTINCT corpus_id, 0, '', '.' FROM kept
      UNION ALL SELECT corpus_id, 1, hex(encode('0000')), '' FROM tot
      UNION ALL SELECT corpus_id, 1, hex(encode('0001')), {totals_text('Stats')} FROM tot
      UNION ALL SELECT corpus_id, 2, sort_hex, rtrim({section('kept', 'omitted')}, {NL}) FROM sk"""
    q["numbered_listing"] = f"""SELECT corpus_id, block, row_number() OVER (PARTITION BY corpus_id ORDER BY block, sort_hex) AS seq, line
      FROM ({q["plain_listing"]})"""
    # sizes do not show in this listing, and contents are the same wherever they lie
    q["referred_listing"] = q["plain_listing"]
    bare_suffix = "CASE WHEN is_dir THEN '/' ELSE '' END"
    bare_el = "el AS (SELECT corpus_id, path, is_dir, NULL::BIGINT AS loc FROM r2 WHERE reason IN ('path_include','included','default'))"
    q["bare_listing"] = f"""WITH {d}, {entries()}, {ANC2}, {decide(SAFE_FILE, SAFE_DIR, unsafe_dir('a'))}, r2 AS (SELECT * FROM r), {bare_el},
      {TOTALS}, {tree(*PLAIN, src='el')}, {hex_key('laid')}, hollow AS (SELECT DISTINCT 'hollow-' || corpus_id AS corpus_id FROM f)
      SELECT corpus_id, 0 AS block, sort_hex, prefix || branch || name || {bare_suffix} AS line FROM keyed
      UNION ALL SELECT DISTINCT corpus_id, 0, '', '.' FROM f
      UNION ALL SELECT corpus_id, 1, hex(encode('0000')), '' FROM tot
      UNION ALL SELECT corpus_id, 1, hex(encode('0001')), {totals_text('Stats')} FROM tot
      UNION ALL SELECT corpus_id, 0, '', '.' FROM hollow
      UNION ALL SELECT corpus_id, 1, hex(encode('0000')), '' FROM hollow
      UNION ALL SELECT corpus_id, 1, hex(encode('0001')), '**Stats**: 📂 0 dirs • 📄 0 files' FROM hollow"""
    above_a = IGN_ABOVE.format(c="corpus_id", p="a", d="true")
    above_self = IGN_ABOVE.format(c="e.corpus_id", p="e.path", d="is_dir")
    above_reason = f"CASE WHEN {above_self} THEN 'ignored' ELSE 'default' END"
    above_dead = f"(a = '.git' OR {above_a})"
    q["ignore_above"] = (
        f"WITH {ABOVE_TREE}, {entries()}, {ANC2}, {decide(above_reason, above_reason, above_dead, git_self)} {SELECT_R}"
    )
    q["manifest_sizes"] = f"""WITH {d} SELECT corpus_id, path, CASE WHEN octet_length(encode(path)) % 3 = 0 THEN size_bytes
      WHEN octet_length(encode(path)) % 2 = 0 THEN octet_length(encode(content)) ELSE 0 END AS size_bytes FROM f"""
    q["shown_sections"] = f"""WITH {d}, ck AS (SELECT *, false AS is_dir FROM f WHERE NOT {IS_BINARY_EXT}),
      sk AS (SELECT t.*, {HEX_KEY.replace('path', 't.path').replace('is_dir', 't.is_dir')} AS sort_hex FROM ck t)
      SELECT corpus_id, sort_hex, CASE WHEN starts_with(path, 'src1/docs/') THEN substr(path, 11)
        WHEN starts_with(path, 'src1/') THEN '../' || substr(path, 6) ELSE '../../' || path END AS heading FROM sk"""
    safe_selection = (
        f"{entries()}, {ANC2}, {decide(SAFE_FILE, SAFE_DIR, unsafe_dir('a'))}, r2 AS (SELECT * FROM r)"
    )
    t_kept = f"t AS (SELECT corpus_id, path, {TYPE} AS file_type FROM kept WHERE NOT is_dir)"
    listing = annotated.split("l AS (SELECT * FROM el)", 1)[1].replace(f"{EMOJI} || ' ' || ", "")
    q["annotated_listing"] = f"""WITH {d}, {safe_selection}, {kept}, {el}, {TOTALS}, {t_kept}, {BREAKDOWN},
      l AS (SELECT * FROM el){listing}, rows AS ({full_rows("''", '▰', '▱')})
      SELECT corpus_id, 0 AS block, sort_hex, line || coalesce('  ' || bar || '  ' || loc_label || '  (' || loc_class || ')' || star, '') AS line FROM ann
      UNION ALL SELECT corpus_id, 1, hex(encode('0000')), '' FROM tot
      UNION ALL SELECT corpus_id, 1, hex(encode(lpad(CAST(seq + 1 AS VARCHAR), 4, '0'))), line FROM rows"""
    return q


STATEMENTS = _statements()
