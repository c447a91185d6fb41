"""Small constant reference tables (broadcast by the operators using them).

FIXED VALUES: entries below must equal the analyzer we reproduce; they are
listed in its order.
"""

from __future__ import annotations

# FIXED VALUES — known-safe packages: (name, max allowed score, suppressed categories)
KNOWN_SAFE = [
    ("typescript", 10, ["filesystem", "process", "code-execution"]),
    ("eslint", 10, ["filesystem", "code-execution", "process"]),
    ("tailwindcss", 10, ["filesystem", "process"]),
    ("postcss", 8, ["filesystem", "code-execution"]),
    ("tsx", 10, ["filesystem", "process", "code-execution"]),
    ("esbuild", 10, ["filesystem", "process", "code-execution", "network"]),
    ("webpack", 10, ["filesystem", "process", "code-execution"]),
    ("vite", 10, ["filesystem", "process", "network", "code-execution"]),
    ("next", 10, ["filesystem", "process", "network", "code-execution"]),
    ("react", 6, ["code-execution"]),
    ("react-dom", 10, ["code-execution", "environment"]),
    ("express", 8, ["network", "code-execution"]),
    ("prisma", 10, ["filesystem", "process", "code-execution", "network"]),
    ("@prisma/client", 10, ["filesystem", "process", "network", "environment", "code-execution"]),
    ("@anthropic-ai/sdk", 10, ["network", "environment"]),
    ("openai", 10, ["network", "environment"]),
    ("axios", 8, ["network"]),
    ("node-fetch", 8, ["network"]),
    ("@clerk/nextjs", 8, ["network", "environment"]),
    ("jsonwebtoken", 6, ["code-execution"]),
    ("bcrypt", 6, ["process"]),
    ("lodash", 2, []),
    ("framer-motion", 2, []),
    ("lucide-react", 1, []),
    ("sharp", 10, ["filesystem", "process"]),
    ("html-to-image", 10, ["code-execution"]),
    ("@nivo/core", 2, []),
    ("@nivo/bar", 2, []),
    ("@nivo/line", 2, []),
    ("@nivo/pie", 2, []),
    ("d3", 4, ["code-execution"]),
    ("@xyflow/react", 3, []),
    ("elkjs", 10, ["code-execution"]),
    ("vitest", 10, ["filesystem", "process", "code-execution"]),
    ("jest", 10, ["filesystem", "process", "code-execution"]),
    ("@types/node", 10, ["filesystem", "process", "network", "code-execution"]),
    ("@types/react", 1, []),
    ("pm2", 10, ["filesystem", "process", "network", "code-execution"]),
    ("nodemon", 10, ["filesystem", "process"]),
]

# FIXED VALUES — popular package names compared against (in order)
POPULAR_PACKAGES = [
    "express", "lodash", "react", "axios", "chalk", "commander", "moment",
    "debug", "uuid", "dotenv", "typescript", "webpack", "eslint", "prettier",
    "jest", "mocha", "bluebird", "underscore", "async", "request", "yargs",
    "inquirer", "glob", "minimist", "semver", "mkdirp", "rimraf", "cheerio",
    "socket.io", "mongoose", "sequelize", "passport", "nodemon", "pm2",
    "next", "nuxt", "vue", "angular", "svelte", "fastify", "koa", "hapi",
    "body-parser", "cors", "helmet", "jsonwebtoken", "bcrypt", "sharp",
    "puppeteer", "redis",
]

# FIXED VALUES — scopes checked for scope confusion (in order)
KNOWN_SCOPES = ["@types", "@babel", "@angular", "@vue", "@react-native"]
