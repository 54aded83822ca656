"""Word lists of the feature catalogue that lexicons.py does not hold, each in full."""

PROGRAMMING_LANGUAGES = ("python", "java", "c", "c++", "cpp", "c#", "javascript", "typescript", "go", "rust", "kotlin", "swift", "php", "dart", "ruby", "scala", "r", "matlab", "bash", "shell", "perl", "haskell", "lua", "assembly", "vb.net", "vba", "groovy", "elixir", "clojure", "fortran", "cobol", "sql", "html", "css")
FRAMEWORKS = ("react", "angular", "vue", "nodejs", "node.js", "django", "flask", "fastapi", "spring", "springboot", "spring boot", "laravel", "express", "expressjs", "next.js", "nextjs", "nuxt.js", "nuxtjs", "bootstrap", "tailwind", "jquery", "redux", "tensorflow", "pytorch", "keras", "sklearn", "scikit-learn", "pandas", "numpy", "matplotlib", "opencv", "langchain", "flutter", "react native", "android sdk", "ionic", "svelte")
DATABASES = ("mysql", "postgresql", "mongodb", "sqlite", "redis", "firebase", "oracle", "sql server", "mariadb", "cassandra", "dynamodb", "elasticsearch", "supabase", "cockroachdb", "neo4j", "sql")
TOOLS = ("git", "github", "gitlab", "docker", "kubernetes", "linux", "aws", "azure", "gcp", "postman", "jira", "figma", "vscode", "intellij", "eclipse", "android studio", "xcode", "jupyter", "colab", "heroku", "netlify", "vercel", "nginx", "apache", "ci/cd", "jenkins", "terraform", "ansible", "tableau", "powerbi", "excel", "ms office", "bash", "vim")
HIGH_VALUE = ("python", "java", "c++", "c#", "machine learning", "deep learning", "tensorflow", "pytorch", "docker", "kubernetes", "aws", "azure", "gcp", "react", "nodejs", "django", "fastapi", "spring boot", "flutter", "computer vision", "nlp", "natural language processing", "data science", "devops", "ci/cd", "microservices", "rest api", "graphql", "system design", "competitive programming", "open source", "blockchain", "cybersecurity", "penetration testing", "ethical hacking", "cloud computing", "artificial intelligence", "generative ai", "llm")
MID_VALUE = ("html", "css", "javascript", "php", "sql", "mysql", "git", "linux", "bash", "android", "ios", "flutter", "react native", "bootstrap", "jquery", "opencv", "pandas", "numpy", "rest api", "json", "xml", "agile", "scrum", "excel", "powerpoint", "figma", "postman", "unit testing", "debugging", "problem solving", "oop", "object oriented", "data structures", "algorithms")
COMMON_LANGUAGES = ("english", "hindi", "gujarati")
TOP_INSTITUTES = ("iit", "nit", "iiit", "iim", "bits pilani", "vit", "manipal", "pes university", "srm university", "amity university", "anna university", "mumbai university", "pune university", "sppu", "delhi university", "du", "bhu", "jadavpur", "hyderabad university", "osmania", "niser", "iiser", "iisc", "tifr")
PERSONAL_INFO = ("date of birth", "dob", "gender", "religion", "marital status", "married", "unmarried", "single", "nationality", "caste", "passport", "father name", "mother name", "permanent address", "aadhaar", "pan card", "voter id", "blood group", "height", "weight")
DEPLOYMENT = ("deployed", "live at", "hosted on", "available at", "production", "github.com", "gitlab.com", "vercel.app", "netlify.app", "heroku", "play store", "app store", "pypi", "npm", "docker hub")
ACTION_VERBS = ("achieved", "built", "created", "designed", "developed", "implemented", "improved", "led", "managed", "optimized", "reduced", "increased", "launched", "delivered", "deployed", "automated", "engineered", "architected", "integrated", "migrated", "refactored", "collaborated", "contributed", "established", "generated", "maintained", "monitored", "resolved", "scaled", "streamlined", "tested", "trained", "upgraded")

BTECH = ("b.tech", "btech", "b.e", "bachelor of technology", "bachelor of engineering", "information technology", "computer engineering", "computer science", "b.e.", "b.tech.", "engineering undergraduate")
BCA = ("bca", "b.c.a", "bachelor of computer applications")
BSC = ("b.sc", "bsc", "bachelor of science", "b.sc it", "bsc it")
MCA = ("mca", "m.c.a", "master of computer applications")
MTECH = ("m.tech", "mtech", "m.e", "master of technology", "master of engineering")
MSC = ("m.sc", "msc", "master of science", "m.sc it", "msc it")
IT_MAJOR = ("computer engineering", "it", "cs", "cse", "ce", "ise", "information science", "computer applications", "electronics and communication", "ece", "software engineering", "engineering undergraduate", "engineering student", "information technology", "computer science")
COURSEWORK = ("coursework", "elective", "relevant courses", "major courses", "core subjects")

COMPETITIVE = ("leetcode", "codeforces", "hackerrank", "hackerearth", "codechef", "competitive programming", "topcoder", "geeksforgeeks")
CERT_PLATFORMS = ("coursera", "udemy", "nptel", "infosys springboard", "tcs ion", "google certified", "aws certified", "microsoft certified", "cisco", "ccna", "oracle certified", "redhat", "comptia", "linkedin learning", "pluralsight", "edx")
MERIT = ("rank", "merit", "topper", "first class", "distinction", "gold medal", "silver medal", "scholarship")
PUBLICATION = ("published", "publication", "paper", "journal", "conference", "ieee", "springer", "research paper")
VOLUNTEER = ("volunteer", "volunteered", "nss", "community service")
LEADERSHIP = ("president", "vice president", "secretary", "captain", "coordinator", "club head", "chapter lead")
WORKSHOP = ("workshop", "seminar", "webinar", "conference attended")
PORTFOLIO = ("portfolio", "personal site", "personal website")

FULL_TIME = ("software engineer", "developer", "analyst", "associate", "consultant", "engineer")
FREELANCE = ("freelance", "freelancer", "self-employed", "consultant")
MNC = ("google", "microsoft", "amazon", "meta", "apple", "infosys", "wipro", "tcs", "hcl", "accenture", "cognizant", "capgemini", "ibm", "oracle")
STARTUP = ("startup", "early stage", "founded", "co-founded")
REMOTE = ("remote", "work from home", "wfh")
MANAGEMENT = ("managed team", "led team", "team lead", "team leader", "managed a team", "managed cross")

ML_PROJECT = ("machine learning", "deep learning", "neural", "ml model", "computer vision", "dataset", "accuracy", "training")
DATABASE_PROJECT = ("database", "sql", "mysql", "mongodb", "sqlite", "firebase", "stored", "retrieve", "query")
API_PROJECT = ("api", "rest", "restful", "graphql", "endpoint", "microservice")
TEAM_PROJECT = ("team", "collaborated", "group", "we built")

# Words that spelling passes over
RESUME_TERMS = ("resume", "profile", "summary", "objective", "career", "skills", "experience", "projects", "education", "certifications", "achievements", "languages", "interests", "professional", "technical", "leadership", "collaboration", "communication", "management", "analysis", "development", "design", "implementation", "optimization", "deployment", "workflow", "automation", "integration", "testing", "debugging", "documentation", "architecture", "scalability", "performance", "app", "tech", "workflows", "project", "intern", "internship", "declaration")
ACADEMIC_TERMS = ("bachelor", "b.tech", "b.e", "b.sc", "bsc", "bca", "b.c.a", "b.sc it", "bsc it", "master", "m.tech", "m.e", "m.sc", "msc", "mca", "m.c.a", "m.sc it", "msc it", "mba", "phd", "diploma", "degree", "engineering", "technology", "science", "information technology", "computer science", "computer engineering", "software engineering", "electronics", "electrical", "mechanical", "civil", "b.com", "m.com", "pgdca")
MAIL_DOMAINS = ("gmail", "yahoo", "hotmail", "outlook", "icloud", "protonmail", "zoho", "rediffmail", "live", "msn")
INSTITUTES = ("iit", "iim", "nit", "iiit", "bits", "mit", "gseb", "cbse", "icse", "gshseb", "stanford", "harvard", "cambridge", "oxford", "nirma", "daiict", "iima", "iitb", "iitd", "mbit", "adit", "gcet", "madhuben", "bhanubhai", "patel", "ultron", "shri")
RESUME_ENTITIES = ("linkedin", "github", "gitlab", "portfolio", "stackoverflow", "hackathon", "internship", "project", "projects", "profile", "objective", "summary", "skills", "education", "experience", "certifications", "achievements", "languages")
SECURITY_TERMS = ("xss", "ssrf", "csrf", "oauth", "jwt", "sql", "nosql", "encryption", "cyber", "cybersecurity")
OCR_TERMS = ("anadvanced", "andtechnology", "andstorage", "fromimages", "myskills", "vehiclebookings", "vehicleregistration", "detectednumber")
INDIAN_TERMS = ("ssc", "hsc", "btech", "be", "bca", "mca", "msc", "mtech", "iit", "nit", "iitb", "iitd", "iitk")
NAMES = ("ayan", "rana", "ruhan", "vohra", "yash", "prajapati", "narendra", "chunara", "athar")
SPELLED_FRAMEWORKS = (
    "firebase", "backend", "frontend", "chatbot", "mongodb", "javascript", "python", "reactjs", "react", "nodejs", "node", "expressjs", "express", "angularjs", "angular", "vuejs", "vue", "django", "flask", "fastapi", "springboot", "spring",
    "tensorflow", "pytorch", "keras", "scikit", "pandas", "numpy", "matplotlib", "seaborn", "opencv", "git", "github", "gitlab", "docker", "kubernetes", "aws", "azure", "gcp", "heroku", "postgresql", "mysql", "sqlite", "redis", "elasticsearch",
    "typescript", "golang", "rust", "kotlin", "swift", "ruby", "php", "laravel", "codeigniter", "symfony", "rails", "bootstrap", "tailwind", "sass", "less", "webpack", "vite", "graphql", "rest", "soap", "microservices", "serverless",
    "ci/cd", "jenkins", "travis", "circleci", "terraform", "ansible", "twilio", "watson", "ibm", "arduino", "esp8266", "iot", "raspberry", "raspberrypi", "microcontroller", "servo", "sensor", "yolo", "cnn", "rnn", "lstm", "transformer", "bert",
    "huggingface", "colab", "kaggle", "anaconda", "jupyter",
)
