"""DuckDB oracle text for the policy plans."""

from __future__ import annotations

PENALISED_CTE = """
  SELECT f.* EXCLUDE (confidence_score, confidence_tier, suppression_reason),
         rn = 1 AS is_winner,
         CASE WHEN rn = 1 THEN suppression_reason ELSE 'duplicate' END AS suppression_reason,
         confidence_score AS old_score, confidence_tier AS old_tier,
         coalesce(used_semantic_context, false) AS penalised,
         CASE WHEN coalesce(used_semantic_context, false)
              THEN round(confidence_score * 0.85 * 10000) / 10000 ELSE confidence_score END
           AS confidence_score,
         confidence_tier AS raw_tier
  FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_run_id, location_hash
                                     ORDER BY confidence_score DESC, created_at, id) AS rn
        FROM findings) f"""

TIERED_CTE = """
  SELECT p.* EXCLUDE (raw_tier),
         CASE WHEN NOT penalised THEN raw_tier
              WHEN (CASE WHEN confidence_score >= 0.8 THEN 3 WHEN confidence_score >= 0.5 THEN 2 ELSE 1 END)
                   < (CASE raw_tier WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)
              THEN (CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium'
                         ELSE 'low' END)
              ELSE raw_tier END AS confidence_tier
  FROM penalised p"""

TRIAGED_CTE = """
  SELECT w.*,
         (category = 'security' AND severity IN ('critical','high')) AS escalated,
         CASE WHEN d.fingerprint IS NOT NULL THEN 'suppress'
              WHEN prior_dup THEN 'suppress'
              WHEN (category = 'security' AND severity IN ('critical','high')) OR confidence_tier = 'high'
                THEN 'inline'
              WHEN confidence_tier = 'medium' THEN 'summary'
              ELSE 'suppress' END AS decision,
         CASE WHEN d.fingerprint IS NOT NULL THEN 'dismissed_fingerprint'
              WHEN prior_dup THEN 'duplicate'
              WHEN (category = 'security' AND severity IN ('critical','high'))
                   OR confidence_tier IN ('high','medium') THEN NULL
              ELSE 'low_confidence' END AS new_reason,
         CASE WHEN d.fingerprint IS NULL AND prior_dup THEN 'prior_run' END AS dup_kind
  FROM (SELECT x.*,
               coalesce(prior_content_hash IS NOT NULL AND content_hash IS NOT NULL
                        AND prior_content_hash = content_hash, false) AS prior_dup
        FROM (SELECT t.*, r.started_at AS run_started_at,
                     lag(t.id) OVER (PARTITION BY location_hash
                                     ORDER BY r.started_at, t.pipeline_run_id, t.id) AS prior_id,
                     lag(t.content_hash) OVER (PARTITION BY location_hash
                                     ORDER BY r.started_at, t.pipeline_run_id, t.id) AS prior_content_hash
              FROM tiered t LEFT JOIN pipeline_runs r ON r.id = t.pipeline_run_id
              WHERE t.is_winner) x) w
  LEFT JOIN dismissed_fingerprints d
    ON d.fingerprint = w.location_hash AND d.repo_full_name = w.repo_full_name
  UNION ALL BY NAME
  SELECT t.*, r.started_at AS run_started_at, CAST(NULL AS VARCHAR) AS prior_id,
         CAST(NULL AS VARCHAR) AS prior_content_hash, false AS prior_dup,
         (category = 'security' AND severity IN ('critical','high')) AS escalated,
         'suppress' AS decision, 'duplicate' AS new_reason, 'within_run' AS dup_kind
  FROM tiered t LEFT JOIN pipeline_runs r ON r.id = t.pipeline_run_id
  WHERE NOT t.is_winner"""

DEDUP_CTE = """
  SELECT f.* EXCLUDE (suppression_reason, rn), rn = 1 AS is_winner,
         CASE WHEN rn = 1 THEN suppression_reason ELSE 'duplicate' END AS suppression_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_run_id, location_hash
                                     ORDER BY confidence_score DESC, created_at, id) AS rn
        FROM findings) f"""

POLICY_CTES = [("penalised", PENALISED_CTE), ("tiered", TIERED_CTE), ("triaged", TRIAGED_CTE),
               ("dedup", DEDUP_CTE)]
