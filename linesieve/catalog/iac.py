"""Configuration rules.

LINE_RULES rows are (rule_id, name, severity, cwe, category, file patterns,
pattern, negative pattern). A rule applies to a file when one file pattern
fits: ``*.x`` is a path suffix, anything else a path substring, both on the
lower-cased path.

IAC-NGX-002 and IAC-K8S-007 fire on ordinary configuration (the negative
pattern looks at the same line only); they are kept for equal results.
"""

# Ids, names, severities, weakness numbers, categories, file
# patterns and patterns must equal the published rule set for equal results.
LINE_RULES = [
    ('IAC-DOCKER-001', 'Docker FROM latest Tag', 'MEDIUM', 'CWE-829', 'Docker', 'Dockerfile dockerfile *.dockerfile',
     r'^\s*FROM\s+\w+(?:/\w+)?(?::latest|\s*$)',
     r'(?i)(?:scratch|AS\s+\w+)'),
    ('IAC-DOCKER-002', 'Docker ADD Instead of COPY', 'LOW', 'CWE-829', 'Docker', 'Dockerfile dockerfile *.dockerfile',
     r'^\s*ADD\s+',
     r'(?:https?://|--chown)'),
    ('IAC-DOCKER-003', 'Docker Secrets in ENV', 'HIGH', 'CWE-798', 'Docker', 'Dockerfile dockerfile *.dockerfile',
     r'(?i)^\s*ENV\s+(?:\w+\s+)?(?:.*(?:PASSWORD|SECRET|KEY|TOKEN|PRIVATE|CREDENTIAL|API_KEY)\s*=)',
     None),
    ('IAC-DOCKER-004', 'Docker EXPOSE All Ports', 'MEDIUM', 'CWE-668', 'Docker', 'Dockerfile dockerfile *.dockerfile',
     r'^\s*EXPOSE\s+(?:22|3306|5432|6379|27017|11211|9200|2375|2376)\b',
     None),
    ('IAC-DOCKER-005', 'Docker apt-get without --no-install-recommends', 'LOW', 'CWE-1104', 'Docker', 'Dockerfile dockerfile *.dockerfile',
     r'apt-get\s+install',
     r'--no-install-recommends'),
    ('IAC-DOCKER-006', 'Docker sudo Usage', 'LOW', 'CWE-250', 'Docker', 'Dockerfile dockerfile *.dockerfile',
     r'^\s*RUN\s+.*\bsudo\b',
     None),
    ('IAC-DOCKER-007', 'Docker Curl Pipe Shell', 'HIGH', 'CWE-829', 'Docker', 'Dockerfile dockerfile *.dockerfile',
     r'(?:curl|wget)\s+.*\|\s*(?:sh|bash|zsh)',
     None),
    ('IAC-DC-001', 'Docker-Compose Privileged Mode', 'CRITICAL', 'CWE-250', 'Docker', 'docker-compose.yml docker-compose.yaml compose.yml compose.yaml',
     r'(?i)privileged\s*:\s*true',
     None),
    ('IAC-DC-002', 'Docker-Compose Host Network Mode', 'HIGH', 'CWE-668', 'Docker', 'docker-compose.yml docker-compose.yaml compose.yml compose.yaml',
     r'''(?i)network_mode\s*:\s*["']?host''',
     None),
    ('IAC-DC-003', 'Docker-Compose Hardcoded Secrets', 'HIGH', 'CWE-798', 'Docker', 'docker-compose.yml docker-compose.yaml compose.yml compose.yaml',
     r'''(?i)(?:PASSWORD|SECRET|KEY|TOKEN)\s*[:=]\s*["'][^"'$\{]{4,}["']''',
     None),
    ('IAC-TF-001', 'Terraform Hardcoded Secret', 'CRITICAL', 'CWE-798', 'Terraform', '*.tf *.tfvars',
     r'(?i)(?:password|secret_key|access_key|token|private_key)\s*=\s*"[^$\{"][^"]{4,}"',
     r'(?i)(?:example|changeme|placeholder|TODO|FIXME)'),
    ('IAC-TF-002', 'AWS Security Group Open to World', 'HIGH', 'CWE-284', 'Terraform', '*.tf',
     r'cidr_blocks\s*=\s*\[\s*"0\.0\.0\.0/0"\s*\]',
     None),
    ('IAC-TF-003', 'S3 Bucket Public Access', 'CRITICAL', 'CWE-284', 'Terraform', '*.tf',
     r'(?i)(?:acl\s*=\s*"public|block_public_acls\s*=\s*false|block_public_policy\s*=\s*false)',
     None),
    ('IAC-TF-004', 'RDS Public Access', 'CRITICAL', 'CWE-284', 'Terraform', '*.tf',
     r'(?i)publicly_accessible\s*=\s*true',
     None),
    ('IAC-TF-005', 'Terraform No Encryption at Rest', 'HIGH', 'CWE-311', 'Terraform', '*.tf',
     r'(?i)(?:encrypted\s*=\s*false|storage_encrypted\s*=\s*false|kms_key_id\s*=\s*"")',
     None),
    ('IAC-TF-006', 'IAM Wildcard Action', 'HIGH', 'CWE-269', 'Terraform', '*.tf *.json',
     r'(?i)(?:"Action"\s*:\s*"\*"|actions?\s*=\s*\[\s*"\*"\s*\])',
     None),
    ('IAC-TF-007', 'CloudTrail Logging Disabled', 'HIGH', 'CWE-778', 'Terraform', '*.tf',
     r'(?i)enable_logging\s*=\s*false',
     None),
    ('IAC-TF-008', 'Terraform HTTP Module Source', 'HIGH', 'CWE-829', 'Terraform', '*.tf',
     r'(?i)source\s*=\s*"http://',
     None),
    ('IAC-K8S-001', 'K8s Container Running as Root', 'HIGH', 'CWE-250', 'Kubernetes', '*.yaml *.yml',
     r'(?i)runAsUser\s*:\s*0',
     None),
    ('IAC-K8S-002', 'K8s Privileged Container', 'CRITICAL', 'CWE-250', 'Kubernetes', '*.yaml *.yml',
     r'(?i)privileged\s*:\s*true',
     None),
    ('IAC-K8S-003', 'K8s hostPath Volume Mount', 'HIGH', 'CWE-250', 'Kubernetes', '*.yaml *.yml',
     r'(?i)hostPath\s*:',
     None),
    ('IAC-K8S-004', 'K8s Host Network', 'HIGH', 'CWE-668', 'Kubernetes', '*.yaml *.yml',
     r'(?i)hostNetwork\s*:\s*true',
     None),
    ('IAC-K8S-005', 'K8s Default Namespace', 'LOW', 'CWE-668', 'Kubernetes', '*.yaml *.yml',
     r'''(?i)namespace\s*:\s*["']?default["']?''',
     None),
    ('IAC-K8S-006', 'K8s Writable Root Filesystem', 'MEDIUM', 'CWE-732', 'Kubernetes', '*.yaml *.yml',
     r'(?i)readOnlyRootFilesystem\s*:\s*false',
     None),
    ('IAC-K8S-007', 'K8s Secrets in Environment Variables', 'MEDIUM', 'CWE-312', 'Kubernetes', '*.yaml *.yml',
     r'(?i)secretKeyRef\s*:',
     None),
    ('IAC-K8S-008', 'K8s Image Pull from Latest', 'MEDIUM', 'CWE-829', 'Kubernetes', '*.yaml *.yml',
     r'(?i)image\s*:\s*\S+:latest',
     None),
    ('IAC-K8S-009', 'K8s Capability ALL', 'CRITICAL', 'CWE-250', 'Kubernetes', '*.yaml *.yml',
     r'(?i)(?:add|capabilities)\s*:.*ALL',
     r'(?i)drop'),
    ('IAC-CI-001', 'CI/CD Secret in Plaintext', 'HIGH', 'CWE-798', 'CI/CD', '.github/workflows .gitlab-ci.yml Jenkinsfile .travis.yml bitbucket-pipelines.yml azure-pipelines.yml',
     r'''(?i)(?:password|secret|token|key)\s*[:=]\s*["'][^$\{"\n]{8,}["']''',
     r'(?i)\$\{\{|%\{|\$\('),
    ('IAC-CI-002', 'GitHub Actions pull_request_target', 'HIGH', 'CWE-250', 'CI/CD', '.github/workflows',
     r'(?i)pull_request_target',
     None),
    ('IAC-CI-003', 'GitHub Actions Script Injection', 'HIGH', 'CWE-78', 'CI/CD', '.github/workflows',
     r'\$\{\{\s*(?:github\.event\.(?:issue|comment|review|pull_request)\.(?:body|title)|github\.head_ref)\s*\}\}',
     None),
    ('IAC-CI-004', 'CI/CD Unsafe Checkout', 'MEDIUM', 'CWE-250', 'CI/CD', '.github/workflows .gitlab-ci.yml',
     r'(?i)persist-credentials\s*:\s*true',
     None),
    ('IAC-NGX-001', 'Nginx Server Tokens Exposed', 'LOW', 'CWE-200', 'Nginx', 'nginx.conf *.nginx *.conf',
     r'(?i)server_tokens\s+on',
     None),
    ('IAC-NGX-002', 'Nginx Missing Security Headers', 'MEDIUM', 'CWE-1021', 'Nginx', 'nginx.conf',
     r'(?i)^\s*server\s*\{',
     r'(?i)X-Frame-Options'),
    ('IAC-NGX-003', 'Nginx Autoindex Enabled', 'MEDIUM', 'CWE-548', 'Nginx', 'nginx.conf *.conf',
     r'(?i)autoindex\s+on',
     None),
    ('IAC-ANS-001', 'Ansible Hardcoded Password', 'HIGH', 'CWE-798', 'Ansible', '*.yaml *.yml',
     r'''(?i)(?:password|passwd|secret)\s*:\s*["']?[^{$\s][^\n"']{4,}''',
     r'(?i)(?:\{\{|vault|lookup|vars\.)'),
    ('IAC-HELM-001', 'Helm Chart Hardcoded Values', 'HIGH', 'CWE-798', 'Helm', 'values.yaml values.yml',
     r'''(?i)(?:password|secret|token|key)\s*:\s*["']?[a-zA-Z0-9+/=_-]{8,}["']?''',
     r'(?i)(?:changeme|placeholder|TODO|FIXME|\{\{)'),
    ('IAC-SH-001', 'Shell Script Secrets', 'HIGH', 'CWE-798', 'Shell', '*.sh *.bash *.zsh',
     r'''(?i)(?:PASSWORD|SECRET|TOKEN|API_KEY|AWS_SECRET)\s*=\s*["'][^$\{]{4,}["']''',
     r'(?i)(?:example|demo|test|placeholder)'),
    ('IAC-SH-002', 'Curl Insecure Flag', 'HIGH', 'CWE-295', 'Shell', '*.sh *.bash *.zsh Dockerfile Makefile *.yaml *.yml',
     r'curl\s+.*(?:--insecure|-k)\s',
     None),
    ('IAC-ANDROID-001', 'Android App Links Placeholder Domain', 'HIGH', 'CWE-926', 'Android', 'AndroidManifest.xml *.xml',
     r'''android:host\s*=\s*["'](?:your\.domain\.com|example\.com|domain\.com|yourapp\.com|your-domain\.com|placeholder\.com|<your[._-]?domain>)''',
     None),
    ('IAC-ANDROID-002', 'Android Backup Enabled', 'MEDIUM', 'CWE-312', 'Android', 'AndroidManifest.xml',
     r'''android:allowBackup\s*=\s*["']true["']''',
     None),
    ('IAC-ANDROID-003', 'Android Cleartext Traffic Permitted', 'HIGH', 'CWE-319', 'Android', 'AndroidManifest.xml network_security_config.xml *.xml',
     r'''android:usesCleartextTraffic\s*=\s*["']true["']''',
     None),
]

# Whole-file rules, reported on line 1.
# (rule_id, name, severity, cwe, category, reported line text)
FILE_RULES = [
    ("IAC-DOCKER-010", "Docker Container Running as Root", "HIGH", "CWE-250", "Docker", "Missing USER instruction"),
    ("IAC-DOCKER-011", "Missing HEALTHCHECK", "LOW", "CWE-693", "Docker", "Missing HEALTHCHECK instruction"),
    ("IAC-K8S-010", "K8s Missing Resource Limits", "MEDIUM", "CWE-770", "Kubernetes", "Missing resources: limits"),
    ("IAC-K8S-011", "K8s No Network Policy", "MEDIUM", "CWE-284", "Kubernetes", "No NetworkPolicy defined"),
    ("IAC-TF-010", "S3 Bucket Missing Encryption", "HIGH", "CWE-311", "Terraform", "aws_s3_bucket without encryption"),
    ("IAC-TF-011", "S3 Bucket Missing Versioning", "LOW", "CWE-693", "Terraform", "aws_s3_bucket without versioning"),
]
