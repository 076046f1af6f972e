"""Words and values that lower or void a match. Fixed values."""

# Published sample credentials (written in parts), placeholder fragments, wording of fixtures,
# wording that generic rules ask for nearby, and patterns of build artefacts.
SAMPLES = (
    "AKIA" "IOSFODNN7EXAMPLE", "wJalrXUtnFEMI/K7MDENG/bPxRfi" "CYEXAMPLEKEY", "sk_" "test_" "BQokikJOvBiI2HlWgH4olfQ2",
    "pk_" "test_" "TYooMQauvdEDq54NiTphI7jx", "sk_" "test_" "4eC39HqLyjWDarjtT1zdp7dc", "pk_" "test_" "6pRNAsCfBOKtIshFeQd4XMUh",
    "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9" ".eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIiwiaWF0IjoxNTE2MjM5MDIyfQ" ".SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c",
)
FRAGMENTS = (
    "EXAMPLEKEY", "EXAMPLEEXAMPLE", "YOUR_API_KEY", "YOURAPIKEY", "REPLACEME", "REPLACE_ME", "PLACEHOLDER", "XXXXXXXX", "INSERT_KEY_HERE",
    "PUT_KEY_HERE", "ENTER_YOUR_KEY", "my_secret_key", "test-secret-key", "'password'", '"password"', "'PASSWORD'", '"PASSWORD"',
    "'Password'", '"Password"', "'passwd'", '"passwd"', "'pwd'", '"pwd"', "'changeme'", '"changeme"', "'CHANGEME'", '"CHANGEME"',
    "'admin'", '"admin"', "'admin123'", '"admin123"', "'12345678'", '"12345678"', "'123456789'", '"123456789"', "'qwerty'", '"qwerty"',
    "'qwerty123'", '"qwerty123"', "'letmein'", '"letmein"', "'test123'", '"test123"', "'secret'", '"secret"', "'default'", '"default"',
)
FIXTURES = ("example", "fixture", "dummy", "sample", "placeholder", "fake_", "mock_", "stub_", "lorem", "fixme", "todo", "// e.g.", "for example")
CONTEXT = ("key", "token", "secret", "auth", "bearer", "api", "private", "credential", "password", "pwd", "session", "access")
SOURCE_MAP_LINE = r"(?i)//[#@]\s*source(?:mapping)?URL="
VENDOR_SOURCE = r"(?i)(?:vendor|chunk|runtime|polyfill|framework|webpack|node_modules)[-_./~]"
EMAIL_PREFIXES = (
    "info@", "career@", "careers@", "jobs@", "admin@", "support@", "contact@", "help@", "noreply@", "no-reply@", "test@", "demo@", "example@",
    "sales@", "marketing@", "press@", "media@", "feedback@", "hello@", "team@", "hr@", "legal@", "privacy@", "abuse@", "postmaster@",
    "webmaster@", "hostmaster@", "security@", "compliance@", "billing@", "service@", "newsletter@", "notifications@", "alerts@", "noemail@",
    "donotreply@", "do-not-reply@", "mailer@", "mail@", "email@", "integration@", "api@", "dev@", "developer@", "developers@",
)
EMAIL_DOMAINS = ("example.com", "test.com", "localhost", "example.org", "example.net", "domain.com", "email.com", "mail.com", "yoursite.com", "yourdomain.com", "sentry.io", "sentry-next.wixpress.com")
