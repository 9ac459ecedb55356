"""Sources: file trees, lockfiles, rules, policies, baselines and changes."""
