"""The table of topics that `tagging.topic_tags` uses unless another one is given."""

from __future__ import annotations

# 28 topics in the order of the tags, each with the lower-case texts one of which must occur.
TOPICS: dict[str, tuple[str, ...]] = {
    "machine-learning": (
        "machine learning", "deep learning", "neural network", "gradient descent", "backpropagation", "convolutional", "random forest", "support vector", "xgboost", "ensemble",
    ),
    "nlp": (
        "natural language", "language model", "transformer", "bert", "gpt", "text classification", "sentiment analysis", "named entity", "question answering", "summarization",
        "word embedding", "tokenization", "parsing",
    ),
    "computer-vision": (
        "image recognition", "object detection", "segmentation", "convolutional neural", "visual", "image classification", "generative adversarial", "diffusion model", "vit",
    ),
    "reinforcement-learning": ("reinforcement learning", "markov decision", "reward function", "policy gradient", "q-learning", "actor-critic", "multi-agent"),
    "large-language-models": (
        "large language model", "llm", "chatgpt", "gpt-4", "instruction tuning", "rlhf", "chain of thought", "prompt engineering", "in-context learning",
    ),
    "graph-neural-networks": ("graph neural", "graph convolutional", "gnn", "knowledge graph", "graph attention"),
    "algorithms": ("algorithm", "computational complexity", "dynamic programming", "sorting", "data structure", "approximation algorithm"),
    "systems": (
        "distributed system", "operating system", "file system", "network protocol", "cloud computing", "kubernetes", "microservice", "database", "consistency",
    ),
    "security": (
        "cybersecurity", "cryptography", "vulnerability", "malware", "intrusion detection", "privacy", "differential privacy", "adversarial attack", "federated learning",
    ),
    "hci": ("human-computer interaction", "user interface", "usability", "user experience", "accessibility", "interface design"),
    "genomics": ("genome", "genomic", "sequencing", "dna", "rna", "crispr", "gene expression", "transcriptome", "epigenetics"),
    "neuroscience": ("neuroscience", "neural circuit", "synaptic", "cortex", "hippocampus", "fmri", "neural plasticity", "connectome"),
    "immunology": ("immune", "antibody", "t cell", "b cell", "cytokine", "vaccine", "inflammation", "autoimmune"),
    "oncology": ("cancer", "tumor", "oncology", "metastasis", "chemotherapy", "immunotherapy", "biomarker"),
    "epidemiology": (
        "epidemiology", "cohort study", "disease incidence", "disease prevalence", "public health", "pandemic", "randomized controlled trial",
    ),
    "drug-discovery": ("drug discovery", "pharmacology", "clinical trial", "drug target", "molecular docking", "protein folding"),
    "climate": ("climate change", "global warming", "greenhouse gas", "carbon emissions", "sea level", "climate model"),
    "quantum": ("quantum computing", "qubit", "entanglement", "quantum mechanics", "superposition", "quantum error correction"),
    "materials-science": ("material science", "nanomaterial", "semiconductor", "polymer", "composite", "crystallography", "superconductor"),
    "astrophysics": ("black hole", "galaxy", "cosmology", "dark matter", "gravitational wave", "exoplanet", "stellar"),
    "economics": ("economic", "gdp", "monetary policy", "inflation", "labour market", "fiscal", "econometrics", "market equilibrium"),
    "psychology": ("cognitive", "behavioral", "mental health", "personality", "social psychology", "memory", "attention", "perception"),
    "education": ("pedagogy", "learning outcome", "curriculum", "higher education", "student performance", "e-learning", "educational technology"),
    "sociology": ("social inequality", "race", "gender", "migration", "social network", "urban", "demographics"),
    "statistics": (
        "bayesian", "markov chain", "monte carlo", "regression", "statistical inference", "hypothesis test", "causal inference", "propensity score", "survival analysis",
    ),
    "optimization": ("convex optimization", "stochastic gradient", "convergence", "loss function", "regularization", "hyperparameter"),
    "robotics": ("robotics", "autonomous vehicle", "path planning", "simultaneous localization", "robot arm", "drone"),
    "energy": ("renewable energy", "solar", "wind energy", "battery", "energy storage", "photovoltaic", "smart grid"),
}
