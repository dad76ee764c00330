"""What to do about a secret that was found, by rule."""

#: Remediation of each secret rule, and of all others.
FIXES = {
    "github-pat": "Revoke the token at https://github.com/settings/tokens, then issue a new one.",
    "github-fine-grained-pat": "Revoke the token at https://github.com/settings/tokens, then issue a new one.",
    "gitlab-pat": "Revoke at GitLab → Settings → Access Tokens, then rotate.",
    "slack-token": "Rotate the token in the Slack app config (api.slack.com/apps) and re-deploy.",
    "stripe-secret": "Roll the key immediately at https://dashboard.stripe.com/apikeys.",
    "aws-access-key": "Deactivate the key in IAM → Security credentials, then create a fresh pair.",
    "npm-token": "Revoke at https://www.npmjs.com/settings/~/tokens and mint a new one.",
    "sendgrid-key": "Delete the key in SendGrid → Settings → API Keys and regenerate.",
    "telegram-bot-token": "Use @BotFather → /revoke to reset the bot token.",
    "discord-bot-token": "Regenerate the token in the Discord Developer Portal → your app → Bot → Reset Token.",
    "anthropic-key": "Revoke at https://console.anthropic.com/settings/keys and issue a new key.",
    "doppler-token": "Revoke the token in Doppler → Settings/Tokens immediately — it can read every project secret.",
    "square-token": "Rotate the token in the Square Developer Dashboard; treat all payment data access as compromised.",
    "hubspot-token": "Rotate the private-app token in HubSpot → Settings → Integrations → Private Apps.",
    "mailchimp-key": "Revoke the key in Mailchimp → Account → Extras → API keys.",
    "linear-key": "Revoke the key in Linear → Settings → API → Personal API keys.",
    "google-api-key": "Regenerate the key in Google Cloud Console → APIs & Services → Credentials, and add restrictions.",
    "openai-key": "Revoke at https://platform.openai.com/api-keys and rotate.",
    "twilio-account-sid": "Rotate the auth token in the Twilio console (Account → API keys & tokens).",
    "github-oauth": "Revoke the token in the GitHub OAuth/GitHub App settings and re-issue.",
    "digitalocean-token": "Regenerate the token at https://cloud.digitalocean.com/account/api/tokens.",
    "mailgun-key": "Rotate the key in the Mailgun dashboard (Settings → API Keys).",
    "figma-token": "Revoke the token in Figma → Settings → Personal access tokens.",
    "notion-token": "Rotate the secret in the Notion integration settings (notion.so/my-integrations).",
    "airtable-token": "Revoke the token at https://airtable.com/create/tokens.",
    "postman-key": "Regenerate the key in Postman → Account Settings → API Keys.",
    "dropbox-token": "Revoke the token in the Dropbox App Console and issue a new one.",
    "shopify-token": "Uninstall/reinstall the app or rotate the token in the Shopify admin.",
    "pypi-token": "Delete the token at https://pypi.org/manage/account/token/ and create a new one.",
    "connection-string-creds": "Move the connection URL to a secret store; rotate the embedded password — it's compromised.",
    "weak-default-password": "Replace the default/weak password and load it from a secret, not a literal.",
    "private-key": "Treat the private key as compromised: rotate the key pair and re-issue any certs signed by it.",
}
OTHER_FIX = "Rotate this credential and remove it from source; load it from an environment variable instead."
