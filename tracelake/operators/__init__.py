"""DataFrame operators over journal tables; one public function for each row of the inventory."""
