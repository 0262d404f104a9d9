"""Explicit schemas of every artefact; readers never infer."""

CITATIONS = "decision_id string, cited_rulings string, laws string, pos long"
RULINGS = "decision_id string, full_text string, file_number string, date string, language string, court string"
CHUNKS = "decision_id string, chunk_id string, chunk_index int, num_chunks int, text string, file_number string, date string, language string, court string"
POINTS = CHUNKS + ", source string, date_ms long, point_id string, vector array<float>"
FACTS = "decision_id string, language string, facts string"
METADATA = "decision_id string, date_ms long, language string, court string"
QUERIES = "query_id string, query_text string, ground_truth_cases array<string>, ground_truth_laws array<string>, language string, year int, date_ms long"
EMBEDDINGS = "query_id string, embedding array<float>"
RESULTS = "query_id string, retrieved array<string>"
POOLS = "query_id string, pool array<string>"
LAYERS = "query_id string, gt_size int, stages array<struct<name: string, pool_size: int, hits: int>>"
PAIR_SCORES = "query_id string, scores map<string, double>"
PER_QUERY = (
    "query_id string, language string, year int, n_ground_truth int, precision double, recall double, f1 double, mrr double, ndcg double,"
    " nearness_score double, nearness_score_undirected double, n_exact int, n_near_1 int, n_near_2 int, n_far int,"
    " n_near_1_undirected int, n_near_2_undirected int, n_far_undirected int"
)
SUMMARY = (
    "system string, ranking string, k int, mean_precision double, mean_recall double, mean_f1 double, mean_mrr double, mean_ndcg double,"
    " mean_nearness_score double, mean_nearness_score_undirected double, n_queries long, hit_rate double"
)
CEILING = "system string, recall_ceiling double, precision_ceiling double, f1_ceiling double, mean_pool_size double, n_queries long"
LAYER_CEILING = (
    "system string, stage string, stage_order int, mean_recall_ceiling double, mean_precision_ceiling double, mean_f1_ceiling double,"
    " mean_pool_size double, n_queries long"
)
RUNS = (
    "run_id long, started_at string, finished_at string, status string, exit_code int, skip_sample boolean, skip_retrieval boolean,"
    " skip_metrics boolean, systems string, rankings string, k_values string, log_path string, duration_s double, error_message string,"
    " query_limit int, resume boolean"
)
LOG = "run_id long, line_no long, line string"
