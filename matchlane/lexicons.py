"""Fixed values of the ranking rules.

Word lists, weights, thresholds and formats here are part of the data
contract: changing one changes results.  Logic lives elsewhere.
"""

# ---- fixed values: tokeniser ------------------------------------------------

STOPWORDS = """
a an and the to of for in on at by with from as is are was were be been being
this that these those it its i we you he she they them his her their our your my
or but if then than so not no yes do does did have has had will would should could
can may might also into out up down very more most less least some any all each other
such about across between through while during
""".split()

SYNONYMS = {
    "ai": "ai_ml",
    "ml": "ai_ml",
    "ml/ai": "ai_ml",
    "ai/ml": "ai_ml",
    "genai": "ai_ml",
    "gen-ai": "ai_ml",
    "llm": "llm",
    "llms": "llm",
    "rag": "rag",
    "ir": "information_retrieval",
    "info-retrieval": "information_retrieval",
    "info_retrieval": "information_retrieval",
    "nlp": "nlp",
    "natural-language-processing": "nlp",
    "ltr": "learning_to_rank",
    "learning-to-rank": "learning_to_rank",
    "vector-db": "vector_database",
    "vectordb": "vector_database",
    "vector-search": "vector_search",
    "embedding": "embeddings",
    "embeddings": "embeddings",
    "fine-tune": "fine_tuning",
    "fine-tuning": "fine_tuning",
    "finetune": "fine_tuning",
    "finetuning": "fine_tuning",
    "qlora": "peft",
    "lora": "peft",
    "peft": "peft",
    "sentence-transformer": "sentence_transformers",
    "sentence-transformers": "sentence_transformers",
    "huggingface": "hugging_face",
    "hugging-face": "hugging_face",
    "tcs": "consulting_firm",
    "infosys": "consulting_firm",
    "wipro": "consulting_firm",
    "accenture": "consulting_firm",
    "cognizant": "consulting_firm",
    "capgemini": "consulting_firm",
    "hcl": "consulting_firm",
    "tech-mahindra": "consulting_firm",
    "mindtree": "consulting_firm",
}

# ---- fixed values: role families (family, score, title keywords) -------------

ROLE_FAMILIES = [
    ("ml_engineer", 3.0, [
        "machine learning engineer", "ml engineer", "applied ml", "applied scientist",
        "ai engineer", "research engineer", "ml scientist", "ai scientist",
        "machine learning scientist",
    ]),
    ("search_ir_engineer", 3.0, [
        "search engineer", "search scientist", "ranking engineer", "retrieval engineer",
        "information retrieval", "recommendation systems engineer", "recsys engineer",
        "personalisation engineer", "personalization engineer",
    ]),
    ("nlp_engineer", 2.8, ["nlp engineer", "nlp scientist", "language model engineer"]),
    ("data_scientist", 1.7, ["data scientist", "research scientist"]),
    ("data_engineer", 1.4, ["data engineer", "analytics engineer", "etl engineer"]),
    ("backend_engineer", 1.1, [
        "backend engineer", "software engineer", "senior software engineer",
        "staff engineer", "principal engineer", "platform engineer",
        ".net developer", "java developer", "python developer", "go developer",
        "rust developer", "spring developer",
    ]),
    ("fullstack_engineer", 0.7, [
        "full stack developer", "full-stack developer", "fullstack developer",
    ]),
    ("frontend_engineer", 0.3, ["frontend engineer", "front-end engineer", "ui engineer"]),
    ("devops_cloud_engineer", 0.4, [
        "devops engineer", "sre", "site reliability engineer",
        "cloud engineer", "infrastructure engineer", "platform reliability",
    ]),
    ("mobile_engineer", 0.2, ["mobile developer", "android developer", "ios developer"]),
    ("qa_engineer", 0.0, ["qa engineer", "test engineer", "sdet", "quality engineer"]),
    ("computer_vision_only", 0.4, [
        "computer vision engineer", "cv engineer", "vision scientist",
    ]),
    ("non_engineering", -1.0, [
        "marketing manager", "sales executive", "operations manager",
        "hr manager", "accountant", "project manager", "business analyst",
        "content writer", "graphic designer", "customer support",
        "mechanical engineer", "civil engineer", "electrical engineer",
        "product manager",
    ]),
]

MANAGEMENT_WORDS = ["manager", "director", "head", "vp", "vice president", "chief"]
BUILDER_WORDS = ["engineer", "developer", "scientist", "architect"]

# ---- fixed values: skill clusters (cluster, members) --------------------------

SKILL_CLUSTERS = [
    ("embeddings_retrieval", [
        "embeddings", "sentence transformers", "sentence-transformers",
        "bge", "e5", "openai embeddings", "vector search", "vector database",
        "faiss", "pinecone", "weaviate", "qdrant", "milvus", "opensearch",
        "elasticsearch", "haystack", "bm25", "information retrieval",
        "semantic search", "hybrid search",
    ]),
    ("ranking_recsys", [
        "recommendation systems", "recsys", "learning to rank", "learning-to-rank",
        "ltr", "xgboost", "lightgbm", "ranking", "ndcg", "mrr",
        "feature engineering", "click-through rate", "ctr",
    ]),
    ("nlp_llm", [
        "nlp", "natural language processing", "transformers",
        "hugging face transformers", "huggingface", "llm", "llms",
        "prompt engineering", "rag", "fine-tuning llms", "fine-tuning",
        "lora", "qlora", "peft", "langchain", "llamaindex",
    ]),
    ("ml_core", [
        "machine learning", "deep learning", "scikit-learn", "sklearn",
        "pytorch", "tensorflow", "statistical modeling", "mlflow", "wandb",
        "weights & biases", "mlops", "kubeflow", "bentoml", "feature store",
    ]),
    ("python_engineering", [
        "python", "fastapi", "flask", "django", "rest apis", "microservices",
        "docker", "kubernetes", "ci/cd", "postgresql", "redis", "kafka",
    ]),
    ("data_engineering", [
        "spark", "pyspark", "airflow", "dbt", "snowflake", "bigquery",
        "databricks", "data pipelines", "etl",
    ]),
    # buzzword surface: used to spot padded claims, never to reward them
    ("ai_keyword_surface", [
        "langchain", "pinecone", "rag", "prompt engineering",
        "fine-tuning llms", "lora", "weaviate", "qdrant",
    ]),
]
SURFACE_CLUSTER = "ai_keyword_surface"
SCORED_CLUSTERS = [name for name, _ in SKILL_CLUSTERS if name != SURFACE_CLUSTER]

VISION_SKILLS = [
    "opencv", "yolo", "image classification", "object detection",
    "image segmentation", "gans", "cnn",
]
SPEECH_SKILLS = ["speech recognition", "tts", "asr", "wav2vec"]

FUZZY_THRESHOLD = 88
CLUSTER_TARGET = 4

PROFICIENCY_WEIGHT = {"beginner": 0.25, "intermediate": 0.55, "advanced": 0.85, "expert": 1.0}
PROFICIENCY_DEFAULT = 0.4

CLUSTER_WEIGHT = {
    "embeddings_retrieval": 0.30,
    "ranking_recsys": 0.20,
    "nlp_llm": 0.20,
    "ml_core": 0.15,
    "python_engineering": 0.10,
    "data_engineering": 0.05,
}
CLUSTER_LABEL = {
    "embeddings_retrieval": "embeddings/vector-search",
    "ranking_recsys": "ranking & recsys",
    "nlp_llm": "NLP/LLM",
    "ml_core": "core ML",
    "python_engineering": "Python & APIs",
    "data_engineering": "data engineering",
}

# ---- fixed values: geography and employers ------------------------------------

PREFERRED_CITIES = ["pune", "noida", "delhi", "gurgaon", "gurugram", "new delhi", "delhi ncr"]
TIER1_CITIES = [
    "bangalore", "bengaluru", "hyderabad", "mumbai", "chennai",
    "pune", "noida", "gurgaon", "gurugram", "delhi", "new delhi",
]
HOME_COUNTRY = "india"

CONSULTING_FIRMS = [
    "tcs", "tata consultancy services", "infosys", "wipro", "accenture", "cognizant",
    "capgemini", "hcl", "hcl technologies", "tech mahindra", "mindtree",
]
PRODUCT_COMPANIES = [
    "swiggy", "zomato", "flipkart", "razorpay", "cred",
    "ola", "uber", "mad street den", "pied piper", "hooli",
    "stark industries", "wayne enterprises", "globex inc",
    "acme corp", "dunder mifflin", "initech",
]

# ---- fixed values: score composition -------------------------------------------

SCORE_WEIGHT = {"title": 0.32, "semantic": 0.22, "skill": 0.28, "experience": 0.12, "location": 0.06}
SCORE_RANGE = (-0.5, 1.5)

# component -> (low, high) used when a component is rescaled to [0, 1]
DISPLAY_RANGE = {
    "title_alignment": (-1.0, 1.0),
    "semantic_fit": (0.0, 1.0),
    "skill_evidence": (0.0, 1.0),
    "experience_band": (0.0, 1.0),
    "location": (0.0, 1.0),
    "behavioural": (0.55, 1.2),
    "honeypot_penalty": (-0.5, 0.0),
}

# ---- fixed values: reasoning ----------------------------------------------------

TONE_LABELS = [(0.85, "Strong match"), (0.65, "Solid match"), (0.40, "Partial fit")]
TONE_FLOOR = "Weak signal"
HOT_WORDS = [
    "retrieval", "ranking", "embedding", "search", "recommendation",
    "rag", "vector", "faiss", "elasticsearch", "ltr",
]

# ---- fixed values: job descriptions ---------------------------------------------

MUST_HAVE = [
    "embeddings", "sentence transformers", "vector database", "FAISS", "Pinecone",
    "Weaviate", "Qdrant", "Milvus", "OpenSearch", "Elasticsearch", "BM25",
    "hybrid search", "information retrieval", "ranking", "NDCG", "MRR", "Python",
    "evaluation",
]
NICE_TO_HAVE = [
    "LoRA", "QLoRA", "PEFT", "fine-tuning", "learning to rank", "XGBoost", "LightGBM",
    "distributed systems", "MLOps", "recsys",
]
DISQUALIFIERS = ["computer vision only", "speech only", "robotics only"]

# section -> (start markers, stop markers)
JD_SECTIONS = {
    "must": (
        ["must have", "must-have", "requirements", "what you'll do", "qualifications", "you have"],
        ["nice to have", "nice-to-have", "preferred", "bonus", "do not want", "we offer", "benefits"],
    ),
    "nice": (
        ["nice to have", "nice-to-have", "preferred", "bonus", "good to have"],
        ["do not want", "we offer", "benefits", "about us", "what we offer"],
    ),
    "reject": (
        ["do not want", "do not", "disqualif", "we will not"],
        ["we offer", "benefits", "about us"],
    ),
}
JD_DEFAULTS = {
    "title": "Senior AI Engineer",
    "role_family": "ml_engineer",
    "min_years": 5.0,
    "max_years": 9.0,
    "notice_days": 30,
    "soft_notice_days": 90,
}
JD_PRIORS = {"min_response_rate": 0.3, "min_interview_completion": 0.4, "max_inactivity_days": 180.0}

# Used when a job row has no text.  Own wording.
DEFAULT_JD_TEXT = """Job Description: Senior AI Engineer - Core Search Team
Location: Pune or Noida, India (hybrid).
Experience Required: 5-9 years.

Must have: embeddings in production (sentence transformers, BGE, E5), a vector database
such as FAISS, Pinecone, Weaviate, Qdrant, Milvus, OpenSearch or Elasticsearch, hybrid search,
strong Python and ranking evaluation with NDCG and MRR.

Nice to have: LoRA, QLoRA or PEFT fine-tuning, learning to rank, MLOps, distributed systems.

Do not want: careers spent only at consulting firms, computer vision only or speech only
profiles, people who are no longer active.
"""
