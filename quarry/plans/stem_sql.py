"""The published Porter2 rules as DuckDB SQL, one column per step, over (token)."""

from __future__ import annotations

from quarry.functions import stemmer as S

_VOWELS = "[aeiouy]"
_VC = "[^aeiouy]*[aeiouy]+[^aeiouy]"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"


def _ending(values) -> str:
    return "(" + "|".join(sorted(values, key=len, reverse=True)) + ")$"


def _short(part: str) -> str:
    """Does ``part`` end in a short syllable?"""
    return f"(CASE WHEN length({part}) = 2 THEN regexp_matches({part}, '^[aeiouy][^aeiouy]$') ELSE regexp_matches({part}, '[^aeiouy][aeiouy][^aeiouywxY]$') END)"


def stems(tokens: str) -> str:
    """SQL for (token, stem) of the relation ``tokens(token)``."""
    return f"""
WITH z0 AS (SELECT DISTINCT token FROM ({tokens})),
z1 AS (SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w,
       CASE WHEN length(token) < 3 THEN token ELSE ({_map(S.WHOLE_WORDS)})[token] END AS done FROM z0),
z2 AS (SELECT *, CASE WHEN regexp_matches(w, '^({"|".join(S.REGION_PREFIXES)})')
         THEN length(regexp_extract(w, '^({"|".join(S.REGION_PREFIXES)})'))
         WHEN regexp_matches(w, '^{_VC}') THEN length(regexp_extract(w, '^{_VC}')) ELSE length(w) END AS r1 FROM z1),
z3 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '^{_VC}')
         THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^{_VC}')) ELSE length(w) END AS r2 FROM z2),
z4 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') THEN left(w, -2)
         WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN left(w, -2) ELSE left(w, -1) END
         WHEN ends_with(w, 'us') OR ends_with(w, 'ss') OR NOT ends_with(w, 's') THEN w
         WHEN regexp_matches(left(w, -2), '{_VOWELS}') THEN left(w, -1) ELSE w END AS w) FROM z3),
z5 AS (SELECT *, w IN {_listed(S.FINAL_AFTER_1A)} AS final, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS e5 FROM z4),
z6 AS (SELECT *, left(w, length(w) - length(e5)) AS b FROM z5),
z7 AS (SELECT * REPLACE (CASE WHEN e5 = '' THEN w
         WHEN e5 IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END
         WHEN NOT regexp_matches(b, '{_VOWELS}') THEN w
         WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
         WHEN length(b) > 1 AND right(b, 2) IN {_listed(S.DOUBLES)}
           THEN CASE WHEN length(b) = 3 AND left(b, 1) IN ('a', 'e', 'o') THEN b ELSE left(b, -1) END
         WHEN length(b) = r1 AND {_short("b")} THEN b || 'e' ELSE b END AS w) FROM z6),
z8 AS (SELECT * REPLACE (CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, -1) || 'i' ELSE w END AS w) FROM z7),
z9 AS (SELECT *, regexp_extract(w, '{_ending(S.STEP2)}') AS e FROM z8),
z10 AS (SELECT * EXCLUDE (e) REPLACE (CASE WHEN e = '' OR length(w) - length(e) < r1 THEN w
         WHEN e = 'ogi' AND NOT ends_with(w, 'logi') THEN w
         WHEN e = 'li' AND NOT regexp_matches(w, '[{"".join(sorted(S.LI_ENDINGS))}]li$') THEN w
         ELSE left(w, length(w) - length(e)) || ({_map(S.STEP2)})[e] END AS w) FROM z9),
z11 AS (SELECT *, regexp_extract(w, '{_ending(S.STEP3)}') AS e FROM z10),
z12 AS (SELECT * EXCLUDE (e) REPLACE (CASE WHEN e = '' OR length(w) - length(e) < r1 OR (e = 'ative' AND length(w) - 5 < r2) THEN w
         ELSE left(w, length(w) - length(e)) || ({_map(S.STEP3)})[e] END AS w) FROM z11),
z13 AS (SELECT *, regexp_extract(w, '{_ending(S.STEP4)}') AS e FROM z12),
z14 AS (SELECT * EXCLUDE (e) REPLACE (CASE WHEN e = '' OR length(w) - length(e) < r2 THEN w
         WHEN e = 'ion' AND NOT regexp_matches(w, '[st]ion$') THEN w ELSE left(w, length(w) - length(e)) END AS w) FROM z13),
z15 AS (SELECT * REPLACE (CASE
         WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {_short("left(w, -1)")})) THEN left(w, -1)
         WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, -1) ELSE w END AS w) FROM z14)
SELECT z1.token, replace(coalesce(z1.done, CASE WHEN z5.final THEN z5.w ELSE z15.w END), 'Y', 'y') AS stem
FROM z1 JOIN z5 USING (token) JOIN z15 USING (token)"""
