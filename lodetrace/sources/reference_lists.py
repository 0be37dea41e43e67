"""Reference tables that come with the engine: well-known package names, and the services that
packages and kinds of credentials belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Well-known names of each ecosystem, the best known first.
NPM_POPULAR = """
lodash react react-dom express axios chalk commander debug next vue webpack typescript eslint prettier jest vitest rxjs moment dayjs uuid
dotenv yargs inquirer glob semver classnames redux react-redux styled-components tailwindcss babel rollup esbuild vite nodemon ws socket.io
mongoose sequelize pg mysql mysql2 redis ioredis knex prisma graphql apollo-server body-parser cors helmet passport jsonwebtoken bcrypt
bcryptjs cookie-parser multer nanoid node-fetch cross-env rimraf fs-extra chokidar concurrently husky lint-staged zod yup joi ajv winston
pino react-router react-router-dom formik react-query swr immer mobx zustand recoil three chart.js d3 lodash.merge left-pad colors request
underscore async bluebird q ramda date-fns validator sharp puppeteer playwright cheerio jsdom marked highlight.js prismjs core-js
regenerator-runtime tslib react-native expo electron firebase aws-sdk stripe openai googleapis discord.js telegraf nestjs fastify koa
""".split()
PYPI_POPULAR = """
requests urllib3 setuptools certifi charset-normalizer idna numpy pandas scipy matplotlib flask django fastapi starlette uvicorn gunicorn
sqlalchemy pydantic click jinja2 werkzeug markupsafe pyyaml python-dateutil six boto3 botocore pytest tox black flake8 mypy isort pylint
coverage pillow scikit-learn tensorflow torch keras transformers beautifulsoup4 lxml scrapy selenium aiohttp httpx redis celery pymongo
psycopg2 openai anthropic langchain tqdm rich typer poetry pip wheel virtualenv cryptography
""".split()

# Packages and the service whose client they are; prefixes of package names; kinds of credentials.
PACKAGE_SERVICES = {
    "stripe": "Stripe", "@stripe/stripe-js": "Stripe", "openai": "OpenAI", "@anthropic-ai/sdk": "Anthropic", "twilio": "Twilio", "@sendgrid/mail": "SendGrid", "googleapis": "Google",
    "firebase": "Firebase", "firebase-admin": "Firebase", "@supabase/supabase-js": "Supabase", "aws-sdk": "AWS", "mongodb": "MongoDB", "mongoose": "MongoDB", "pg": "PostgreSQL",
    "mysql2": "MySQL", "redis": "Redis", "ioredis": "Redis", "algoliasearch": "Algolia", "plaid": "Plaid", "shopify-api-node": "Shopify", "mailchimp": "Mailchimp", "posthog-node": "PostHog",
    "mixpanel": "Mixpanel", "@notionhq/client": "Notion", "discord.js": "Discord", "telegraf": "Telegram", "octokit": "GitHub",
}
PREFIX_SERVICES = [("@aws-sdk/", "AWS"), ("@octokit/", "GitHub"), ("@google-cloud/", "Google Cloud"), ("@slack/", "Slack"), ("@sentry/", "Sentry"), ("@shopify/", "Shopify"), ("@azure/", "Azure")]
CREDENTIAL_SERVICES = {"stripe-secret": "Stripe", "google-api-key": "Google", "slack-token": "Slack", "github-pat": "GitHub", "gitlab-pat": "GitLab", "aws-access-key": "AWS", "aws-secret-key": "AWS"}


def popular_names(spark: SparkSession) -> DataFrame:
    """(name, ecosystem, rank) of every well-known name; the rank goes on from npm to PyPI."""
    rows = [*((n, "npm") for n in NPM_POPULAR), *((n, "pypi") for n in PYPI_POPULAR)]
    return spark.createDataFrame([(n, e, i) for i, (n, e) in enumerate(rows)], "name string, ecosystem string, rank int")


def popular_union(spark: SparkSession) -> DataFrame:
    """(name, rank) of the well-known names of all ecosystems, each once."""
    return popular_names(spark).groupBy("name").agg(F.min("rank").alias("rank"))
