"""Word lists whose entries decide the features, each in full."""

CLOUD = ("aws", "azure", "gcp", "google cloud", "cloud", "s3", "ec2", "lambda", "cloudfront", "heroku", "digitalocean")
AI_ML = ("machine learning", "deep learning", "neural network", "nlp", "computer vision", "tensorflow", "pytorch", "keras", "sklearn", "scikit-learn", "pandas", "numpy", "data science", "llm", "langchain", "generative ai", "reinforcement learning")
MOBILE = ("android", "ios", "flutter", "react native", "kotlin", "swift", "dart", "mobile app", "mobile application")
DEVOPS = ("docker", "kubernetes", "ci/cd", "jenkins", "github actions", "terraform", "ansible", "devops", "helm", "prometheus")
SECURITY = ("penetration testing", "ethical hacking", "cybersecurity", "xss", "sql injection", "ssrf", "owasp", "burp suite", "metasploit", "wireshark", "nmap", "kali linux")
WEB = ("react", "angular", "vue", "django", "flask", "fastapi", "nodejs", "html", "css", "bootstrap", "tailwind", "nextjs", "laravel", "spring boot", "rest api")
DATA = ("spark", "hadoop", "kafka", "airflow", "tableau", "powerbi", "dbt", "etl", "data pipeline", "data warehouse", "bigquery")
TESTING = ("unit testing", "selenium", "jest", "pytest", "junit", "testng", "tdd", "bdd", "postman", "swagger")
CATEGORIES = {"cloud": CLOUD, "ai_ml": AI_ML, "web_dev": WEB, "mobile": MOBILE, "devops": DEVOPS, "security": SECURITY, "data": DATA, "testing": TESTING}

BACHELOR = ("b.tech", "btech", "b.e", "be", "bsc", "b.sc", "bca", "b.c.a", "b.sc it", "bsc it", "bachelor", "b.eng", "undergraduate")
MASTER = ("m.tech", "mtech", "m.e", "msc", "m.sc", "mca", "m.c.a", "m.sc it", "msc it", "master", "m.eng", "postgraduate", "pg")
DIPLOMA = ("diploma", "polytechnic", "d.tech", "d.c.s")
PHD = ("phd", "ph.d", "doctorate", "doctoral")
DEGREES = {"bachelor": BACHELOR, "master": MASTER, "diploma": DIPLOMA, "phd": PHD}

HACKATHON = ("hackathon", "hack", "marathon", "ssip", "smart india hackathon", "code unnati", "code for good", "devhack", "buildathon", "ideathon", "innovation challenge", "innovation marathon")
COMPETITION = ("competition", "contest", "olympiad", "quiz", "treasure hunt", "code sprint", "codejam", "kaggle", "codeathon")
OPEN_SOURCE = ("open source", "open-source", "pull request", "pr merged", "contributor", "maintained repo", "forked", "npm package", "pypi package", "published package", "github contributions")
CERTIFIED = ("certified", "certification", "certificate")
SOFT = ("communication", "leadership", "teamwork", "collaborative", "problem solving", "critical thinking", "adaptability", "time management", "presentation", "mentoring", "interpersonal", "analytical", "creative", "innovative")
INTERNSHIP = ("intern", "internship", "trainee", "apprentice", "industrial training", "summer intern", "winter intern")
BUZZWORDS = ("hardworking", "passionate", "self-motivated", "go-getter", "synergy", "leverage", "paradigm", "results-driven", "detail-oriented", "team player", "fast learner", "dynamic", "proactive", "strong work ethic", "highly motivated")
EXTRAS = {"hackathon": HACKATHON, "competition": COMPETITION, "open_source": OPEN_SOURCE, "certifications": CERTIFIED, "soft_skills": SOFT, "internship": INTERNSHIP, "buzzwords": BUZZWORDS}
