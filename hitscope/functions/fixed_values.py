"""Fixed values.

Word lists, patterns, weights and thresholds that decide results.  They are
data, stated plainly; the code that applies them lives in the other modules.
"""

# --- fixed values: user-agent signatures that mark a client as a bot -------
BOT_SIGNATURES = (
    # classic crawlers and tools
    "googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider",
    "yandexbot", "facebookexternalhit", "twitterbot", "linkedinbot",
    "whatsapp", "telegrambot", "applebot", "amazonbot", "crawl",
    "spider", "bot", "scraper", "curl", "wget", "python-requests",
    "postman", "insomnia", "httpie",
    # AI clients
    "chatgpt", "gpt-bot", "openai", "gpt-4", "gpt-3.5",
    "claude", "anthropic", "claude-bot", "bard", "google-bard", "palm-bot",
    "copilot", "github-copilot", "microsoft-copilot", "perplexity", "perplexitybot",
    "ccbot", "common-crawl", "commoncrawl", "ai2bot", "allen-institute",
    "anthropic-ai", "claude-web", "research-bot", "academic-crawler", "university-bot",
    "huggingface", "hf-bot", "jasper", "copy.ai", "writesonic", "contentbot",
    "midjourney", "dall-e", "stable-diffusion", "imagen", "ai-seo", "rank-math-ai",
    "yoast-ai", "surfer-ai", "marketo-ai", "hubspot-ai", "salesforce-ai",
    "chatbot", "virtual-assistant", "dialogflow", "rasa", "alexa", "siri",
    "google-assistant", "cortana", "ai-api", "ml-service", "neural-bot",
    "tensorflow-bot", "automated-ai", "ai-automation", "ml-automation",
)

# --- fixed values: signatures of the short bot test used by the TSV format -
TSV_BOT_WORDS = ("bot", "crawler", "spider")

# --- fixed values: bot signature -> category, first listed match wins ------
BOT_CATEGORIES = {
    "googlebot": "search_engine",
    "bingbot": "search_engine",
    "slurp": "search_engine",
    "duckduckbot": "search_engine",
    "baiduspider": "search_engine",
    "yandexbot": "search_engine",
    "applebot": "search_engine",
    "facebookexternalhit": "social_media",
    "twitterbot": "social_media",
    "linkedinbot": "social_media",
    "whatsapp": "social_media",
    "telegrambot": "social_media",
    "chatgpt": "ai_llm",
    "gpt-bot": "ai_llm",
    "openai": "ai_llm",
    "claude": "ai_llm",
    "anthropic": "ai_llm",
    "bard": "ai_llm",
    "copilot": "ai_llm",
    "perplexity": "ai_llm",
    "ccbot": "ai_llm",
    "uptimerobot": "monitoring",
    "pingdom": "monitoring",
    "newrelic": "monitoring",
    "nessus": "security_scanner",
    "qualys": "security_scanner",
    "acunetix": "security_scanner",
    "curl": "generic",
    "wget": "generic",
    "python-requests": "generic",
}
GENERIC_BOT_WORDS = ("bot", "crawler", "spider")

# --- fixed values: AI client names -----------------------------------------
AI_BOT_NAMES = (
    "chatgpt", "gpt-bot", "openai", "gpt-4", "gpt-3.5",
    "claude", "anthropic", "bard", "google-bard",
    "copilot", "perplexity", "ccbot", "common-crawl",
)

# --- fixed values: base legitimacy score per bot category ------------------
BOT_BASE_SCORES = {
    "search_engine": 95.0,
    "social_media": 90.0,
    "monitoring": 85.0,
    "ai_llm": 70.0,
    "security_scanner": 60.0,
    "generic": 40.0,
}
BOT_DEFAULT_SCORE = 30.0

# --- fixed values: attack patterns -----------------------------------------
ATTACK_PATTERNS = {
    "sql_injection": r"(?i)(union|select|insert|update|delete|drop|alter|exec|script|javascript|<script)",
    "xss": r"(?i)(<script|javascript:|on\w+=|<iframe|<object|<embed)",
    "directory_traversal": r"\.\./|\.\.\%2[fF]|\.\.\\",
    "command_injection": r"(?i)(;|\||&&|\$\(|`)",
    "file_inclusion": r"(?i)(file://|php://|expect://|data:)",
    "sensitive_files": r"(?i)(\.(git|svn|hg)/|\.env|wp-config\.php|configuration\.php|config\.yml|\.htaccess|\.htpasswd|id_rsa|authorized_keys|backup\.sql|dump\.sql|\.bak|\.old|\.backup|composer\.json|package\.json|requirements\.txt|phpinfo\.php|info\.php)",
    "web_shell": r"(?i)(c99|r57|wso|b374k|p0wny|eval\(|base64_decode\(|system\(|passthru\(|shell_exec\(|exec\()",
    "log4shell": r"(?i)\$\{jndi:(ldap|rmi|dns|ldaps|iiop|corba|nds|nis):",
    "ssrf": r"(?i)(127\.0\.0\.1|localhost|0\.0\.0\.0|192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.169\.254|file://|dict://|gopher://)",
    "open_redirect": r"(?i)[\?&](url|redirect|next|return|continue|dest|destination|redir|redirect_uri)=https?://",
    "xxe": r"""(?i)(<!ENTITY|<!DOCTYPE|SYSTEM\s+["']|PUBLIC\s+["'])""",
    "crlf_injection": r"(%0d%0a|%0D%0A|\\r\\n|%00)",
    "template_injection": r"(\{\{|\{%|<%|\$\{|#set\(|\[#assign)",
    "nosql_injection": r"(?i)(\[\$ne\]|\[\$gt\]|\[\$regex\]|\[\$where\]|\$where:)",
    "prototype_pollution": r"(?i)(__proto__|constructor\.prototype|prototype\.)",
    "path_traversal_ext": r"(%2e%2e/|%252e%252e/|\.\.%c0%af|\.\.%c1%9c|\\u002e\\u002e/|\.\.\\|%5c\.\.%5c)",
}

# --- fixed values: attack tools named in user agents -----------------------
MALICIOUS_USER_AGENTS = (
    "sqlmap", "nikto", "nmap", "masscan", "dirbuster", "gobuster",
    "nuclei", "metasploit", "havij", "acunetix", "nessus", "openvas",
    "w3af", "skipfish", "arachni", "zap", "burp", "paros",
    "hydra", "medusa", "netsparker", "appscan", "webinspect",
)

# --- fixed values: anomalous request methods -------------------------------
SUSPICIOUS_METHODS = ("TRACE", "TRACK", "DEBUG", "CONNECT")

# --- fixed values: login and admin paths -----------------------------------
BRUTE_FORCE_WORDS = (
    "login", "signin", "auth", "wp-login", "admin",
    "administrator", "user/login", "account/login",
)
CREDENTIAL_WORDS = ("login", "signin", "auth", "authenticate")
ADMIN_PATHS = (
    "/admin", "/administrator", "/wp-admin", "/wp-login.php", "/admin.php",
    "/backend", "/adminpanel", "/control", "/cpanel", "/manager",
)
FAILED_LOGIN_STATUSES = (401, 403)

# --- fixed values: threat-score weight per attack type ---------------------
THREAT_WEIGHTS = {
    "web_shell": 25, "log4shell": 25, "xxe": 25, "ssrf": 25,
    "command_injection": 25, "sql_injection": 25,
    "sensitive_files": 15, "credential_stuffing": 15,
    "template_injection": 15, "nosql_injection": 15,
    "xss": 10, "directory_traversal": 10, "path_traversal_ext": 10,
    "crlf_injection": 10, "open_redirect": 10, "prototype_pollution": 10,
    "brute_force": 10,
    "scanning": 5, "http_method_anomaly": 5, "malicious_ua": 5, "api_abuse": 5,
}

# --- fixed values: severity and text of threat events ----------------------
THREAT_SEVERITY = {
    "sql_injection": "critical",
    "command_injection": "critical",
    "xss": "high",
    "directory_traversal": "high",
    "file_inclusion": "critical",
    "brute_force": "medium",
    "scanning": "low",
}
THREAT_TEXT = {
    "sql_injection": "SQL injection attempt detected in request",
    "xss": "Cross-site scripting (XSS) attempt detected",
    "directory_traversal": "Directory traversal attempt detected",
    "command_injection": "Command injection attempt detected",
    "file_inclusion": "File inclusion attempt detected",
    "brute_force": "Brute force login attempt detected",
    "scanning": "Security scanning behavior detected",
}

# --- fixed values: recommendation per lower score bound --------------------
RECOMMENDATIONS = (
    (80, "BLOCK IMMEDIATELY - Critical threat detected"),
    (60, "Consider blocking - High threat level"),
    (40, "Monitor closely - Moderate threat level"),
    (20, "Watch for patterns - Low threat level"),
)
RECOMMENDATION_DEFAULT = "Continue monitoring"

# --- fixed values: labels and severities of the extended attack table ------
EXTENDED_ATTACK_LABELS = {
    "web_shell": ("Web Shell Detection", "CRITICAL"),
    "log4shell": ("Log4Shell/JNDI", "CRITICAL"),
    "xxe": ("XXE/XML Injection", "CRITICAL"),
    "ssrf": ("SSRF", "CRITICAL"),
    "sensitive_files": ("Sensitive File Access", "HIGH"),
    "credential_stuffing": ("Credential Stuffing", "HIGH"),
    "template_injection": ("Template Injection", "HIGH"),
    "nosql_injection": ("NoSQL Injection", "HIGH"),
    "path_traversal_ext": ("Path Traversal (Extended)", "MEDIUM"),
    "crlf_injection": ("CRLF/Header Injection", "MEDIUM"),
    "open_redirect": ("Open Redirect", "MEDIUM"),
    "prototype_pollution": ("Prototype Pollution", "MEDIUM"),
    "http_method_anomaly": ("HTTP Method Anomaly", "LOW"),
    "api_abuse": ("API Abuse", "LOW"),
}
ATTACK_LABELS = {
    "directory_traversal": "Directory Traversal",
    "brute_force": "Brute Force",
    "sql_injection": "SQL Injection",
    "xss": "XSS",
    "command_injection": "Command Injection",
    "web_shell": "Web Shell",
    "scanning": "Scanning",
}
SECURITY_ADVICE = {
    "ddos": "Consider implementing rate limiting for IPs with high request rates",
    "high_threat": "Review and consider blocking suspicious IPs with threat scores >= 70",
    "brute_force": "Implement account lockout policies after failed login attempts",
    "scanning": "Monitor scanning behavior from IPs with high error rates",
    "none": "Continue monitoring for suspicious activity",
}

# --- fixed values: API paths, GraphQL operations ---------------------------
API_WORDS = ("/api/", "/rest/", "/graphql", "/wp-json/", "/store-api/", "/v1/", "/v2/", "/v3/")
ABUSE_API_WORDS = ("/api/", "/rest/", "/graphql")
API_ONLY_PATTERN = r"(?i)/(api|graphql|rest|wp-json)"
GRAPHQL_OPERATIONS = (
    "IntrospectionQuery", "GetProduct", "AddToCart", "GetCart",
    "GetCustomer", "GetCategories", "GetCmsPage", "Checkout",
)

# --- fixed values: shop platforms, in order of priority --------------------
SHOP_PLATFORMS = {
    "magento": (
        "/graphql", "/rest/V1/", "/customer/section/load", "/checkout/",
        "/catalogsearch/", "/api/rest/", "Magento_",
    ),
    "woocommerce": (
        "/?wc-ajax=", "/wp-json/wc/", "/cart/", "/checkout/", "/my-account/", "wc-api",
    ),
    "shopware": (
        "/store-api/", "/api/", "/admin/api/", "/checkout/", "/account/",
    ),
}
SHOP_CATEGORIES = (
    ("product", ("product", "catalog")),
    ("cart", ("cart", "basket")),
    ("checkout", ("checkout", "payment")),
    ("account", ("account", "customer")),
    ("search", ("search", "catalogsearch")),
    ("order", ("order",)),
)
SHOP_PLATFORM_CATEGORIES = {
    "magento": (("api", ("/rest/v1/", "/graphql")), ("customer_section", ("customer/section/load",))),
    "woocommerce": (("ajax", ("wc-ajax",)), ("api", ("wp-json/wc",))),
    "shopware": (("api", ("store-api",)), ("account", ("/account",))),
}

# --- fixed values: file extensions -----------------------------------------
RESOURCE_CATEGORIES = {
    "image": (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico"),
    "script": (".js", ".jsx", ".ts", ".tsx"),
    "style": (".css", ".scss", ".sass", ".less"),
    "media": (".mp4", ".webm", ".mp3", ".ogg", ".wav"),
    "document": (".pdf", ".doc", ".docx", ".xls", ".xlsx"),
}
CONTENT_TYPES = {
    ".html": "text/html",
    ".css": "text/css",
    ".js": "application/javascript",
    ".json": "application/json",
    ".xml": "application/xml",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".svg": "image/svg+xml",
    ".pdf": "application/pdf",
    ".zip": "application/zip",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
SEO_ISSUES = {
    "large_images": ("medium", "Images larger than 500KB detected - consider optimization"),
    "broken_links": ("high", "404 errors detected - broken links affect SEO"),
    "slow_resources": ("medium", "Slow loading resources detected - impacts page speed"),
}

# --- fixed values: performance recommendations -----------------------------
PERFORMANCE_ADVICE = {
    "response_time": (
        "high", "Average response time is high (>1s)", "User experience degradation",
        "Optimize database queries, add caching, or scale resources"),
    "response_time_p95": (
        "medium", "P95 response time is very high (>3s)",
        "Poor experience for significant portion of users",
        "Identify and optimize slowest endpoints"),
    "slow_endpoints": (
        "high", "Multiple slow endpoints detected",
        "Performance bottlenecks affecting user experience",
        "Review and optimize slow endpoints, consider caching"),
    "cache_hit_rate": (
        "high", "Low Varnish cache hit rate (<50%)",
        "Increased load on backend, slower response times",
        "Review cache configuration and cache-control headers"),
    "handler_errors": (
        "critical", "High error rate for handler: ", "Service reliability issues",
        "Investigate and fix errors in "),
}

# --- fixed values: anomaly texts, alert thresholds -------------------------
ANOMALY_TEXT = {
    "traffic_spike": "Unusual traffic volume detected",
    "error_rate": "Unusual error rate detected",
    "response_time": "Unusual response time detected",
}
ALERT_ERROR_RATE = 0.5
ALERT_REQUESTS_PER_MINUTE = 1000
ALERT_UNIQUE_IPS_PER_MINUTE = 100

# --- fixed values: where access logs are looked for ------------------------
LOG_GLOBS = ("access.log*", "nginx/access.log*", "nginx/*/access.log*")
DEFAULT_LOG_PATHS = (
    "/var/log/nginx/access.log",
    "/var/log/nginx/access.log.1",
    "/data/log/nginx/access.log",
    "/data/log/nginx/access.log.1",
)
BLOCKED_STATUSES = (403, 429)
